"""SQL for DuckDB that gives the rows of this subpackage's queries, where SQL can express them."""

from __future__ import annotations

from .licenses import ANCHOR, CONFIRM, TEMPLATES, UNKNOWN, N, trained
from .secrets import _ALL, _CLASSES, ACCESS, ASSIGN, CANDIDATE, ENCODINGS, HEX, KINDS, _DIGITS, _LOW, _UP

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[i + 1:i + 13] AS g FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(g) AS n FROM g),
x AS (SELECT doc_id, n, i, w[i + 1:i + n] AS g FROM (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM x JOIN g USING (g)),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP4 = """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95),
r(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
n AS (SELECT a, count(*) AS n FROM k GROUP BY a), c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.b, vec_id)) AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""

OP5 = """WITH s AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substring(x, 2 * i + 1, 100)) AS g FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM s WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING count(*) > 1),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m) GROUP BY doc_id, k),
o AS (SELECT doc_id, a, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
q AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(e) + 1) AS kept FROM o JOIN s USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM s LEFT JOIN q USING (doc_id)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(kind: int, pattern: str, group: int) -> str:
    p = _q(pattern.replace(r"\x20", " "))
    return f"""SELECT doc_id, {kind} AS kind, unnest(range(len(m))) AS i, unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS gap, unnest(list_transform(m, lambda x: length(x))) AS len,
unnest(list_transform(v, lambda x: length(x))) AS size, unnest(v) AS token FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS g FROM d) WHERE len(m) > 0"""


def _tail(z: str) -> str:
    return f"CASE WHEN {z} < -3 THEN exp(-({z}) * ({z}) / 2) / (2.5066282746310002 * greatest(abs({z}), 1.0)) ELSE 1 / (1 + exp(-1.5976 * ({z}) - 0.070565992 * ({z}) * ({z}) * ({z}))) END"


def op1(rate: float = 0.01) -> str:
    """The fixed patterns and the test battery, with the same figures."""
    which = "CASE " + " ".join(f"WHEN regexp_full_match(s, {_q(p)}) THEN {k}" for k, (_, p, _, _) in enumerate(ENCODINGS)) + " END"
    pick = lambda values: f"[{', '.join(values)}][k + 1]"
    share = [repr(float(1 - sum((sum(c in part for c in e[2]) / len(e[2])) ** 2 for part in (_LOW, _UP, _DIGITS, "+/-_")))) for e in ENCODINGS]
    names = "[" + ", ".join(map(_q, KINDS)) + "]"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_found(0, ASSIGN, 2)} UNION ALL {_found(1, ACCESS, 0)} UNION ALL {_found(2, HEX, 0)} UNION ALL {_found(3, CANDIDATE, 0)}),
p AS (SELECT doc_id, kind, token, size, sum(gap + len) OVER (PARTITION BY doc_id, kind ORDER BY i) - len AS s0, len FROM m),
b AS (SELECT doc_id, kind, s0::BIGINT AS a, (s0 + len)::BIGINT AS z, token FROM p WHERE kind <> 0 OR size >= 8),
t0 AS (SELECT *, regexp_replace(token, '=+$', '') AS s FROM b WHERE kind = 3 AND NOT regexp_matches(token, '^[0-9=]+$')),
t1 AS (SELECT *, {which} AS k, greatest(length(s), 2)::DOUBLE AS n FROM t0),
t2 AS (SELECT *, {pick([_q(e[2]) for e in ENCODINGS])} AS ab, {pick([repr(e[3]) for e in ENCODINGS])}::DOUBLE AS same, {pick(share)}::DOUBLE AS turn, translate(s, {_q(_ALL)}, {_q(_CLASSES)}) AS cl FROM t1),
t3 AS (SELECT *, length(ab)::DOUBLE AS sz, length(ab)::DOUBLE / n * list_sum(list_transform(string_split(ab, ''), lambda c: pow(n - length(replace(s, c, '')), 2.0))) - n AS chi,
list_transform(string_split(s, ''), lambda c: instr(ab, c)::DOUBLE - (length(ab)::DOUBLE + 1) / 2) AS x, list_sum(list_transform(range(1, length(cl)), lambda i: CASE WHEN cl[i] <> cl[i + 1] THEN 1.0 ELSE 0.0 END)) AS turns FROM t2),
t4 AS (SELECT *, list_sum(list_transform(range(1, len(x)), lambda i: x[i] * x[i + 1])) / ((n - 1) * (sz * sz - 1) / 12) * sqrt(n - 1) AS serial, (chi - (sz - 1)) / sqrt(2 * (sz - 1) * (n - 1) / n) AS z_chi,
CASE WHEN turn > 0 THEN (turns - (n - 1) * turn) / sqrt((n - 1) * turn * (1 - turn) + 1e-9) ELSE 0.0 END AS z_runs, (n - 1) * (sz * same - 1) AS uneven FROM t3),
t5 AS (SELECT *, least({_tail("-z_chi")}, 2 * ({_tail("-abs(z_runs)")}), 2 * ({_tail("-abs(serial)")})) AS worst, (chi - (sz - 1) - uneven) / sqrt(2 * (sz - 1) + 4 * uneven + pow(0.2 * uneven, 2.0)) AS tc,
CASE WHEN turn > 0 THEN ((n - 1) * 0.25 - turns) / sqrt((n - 1) * 0.19) END AS tr FROM t4),
t6 AS (SELECT *, CASE WHEN turn > 0 THEN (tc + tr) / sqrt(2.0) ELSE tc END AS j FROM t5),
t7 AS (SELECT *, 3 * worst >= 0.001 AS uniform, greatest({_tail("j")}, 1e-300) AS pv, least(floor(log2(n)), 7)::INTEGER AS lc FROM t6),
t8 AS (SELECT *, floor(-log10(pv) * 10)::INTEGER AS bin FROM t7),
h AS (SELECT lc, bin, count(*) AS c FROM t8 GROUP BY lc, bin), r AS (SELECT *, sum(c) OVER (PARTITION BY lc ORDER BY bin DESC) AS rank, sum(c) OVER (PARTITION BY lc) AS alln FROM h),
lim AS (SELECT lc, min(bin) AS least_bin FROM r WHERE pow(10.0, -bin / 10.0) * alln <= {rate} * rank GROUP BY lc),
q AS (SELECT doc_id, kind, a, z FROM b WHERE kind < 3 UNION ALL SELECT doc_id, kind, a, z FROM t8 JOIN lim USING (lc) WHERE uniform AND bin >= least_bin),
o AS (SELECT *, max(CASE WHEN kind < 3 THEN z END) OVER (PARTITION BY doc_id ORDER BY a, kind ROWS UNBOUNDED PRECEDING) AS covered FROM q),
y AS (SELECT doc_id, kind, {names}[kind + 1] || ':' || a || ':' || z AS w, a, z FROM o WHERE kind < 3 OR covered IS NULL OR covered < z),
f AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, string_agg(w, ',' ORDER BY a, kind, z) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY a, kind, z) AS spans FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""


def op3(confirm: float = CONFIRM) -> str:
    """The trained weights as a table of values."""
    m = trained()
    rows = ", ".join(f"({_q(g)}, [{', '.join(map(repr, m.weights[g]))}], [{', '.join(map(str, m.templates.get(g, ())))}]::INTEGER[])" for g in sorted(m.weights))
    n_class, n_template = len(m.classes), len(TEMPLATES)
    z = ", ".join(f"(coalesce(sum(v.w[{k + 1}]), 0) + ({m.bias[k]!r})) / {m.temperature!r}" for k in range(n_class))
    share = ", ".join(f"count(*) FILTER (list_contains(v.t, {k})) / {m.sizes[k]}.0::DOUBLE" for k in range(n_template))
    best = "CASE k " + " ".join(
        f"WHEN {c} THEN list_max([{', '.join(f'round(share[{t + 1}], 9)' for t, (f, _) in enumerate(TEMPLATES) if f == name)}])" for c, name in enumerate(m.classes[:-1])
    ) + " ELSE 0.0 END"
    names = "[" + ", ".join(map(_q, m.classes)) + "]"
    runs = " || ".join(f"list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in range(1, N + 1))
    return f"""WITH v(g, w, t) AS (VALUES {rows}), d AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS par FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
c AS (SELECT doc_id, line, regexp_extract_all(lower(par), '[a-z0-9]+') AS w FROM d WHERE regexp_matches(par, {_q(ANCHOR)})),
g AS (SELECT doc_id, line, unnest(list_distinct({runs})) AS g FROM c),
s AS (SELECT c.doc_id, c.line, [{z}] AS z, [{share}] AS share FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.line = c.line LEFT JOIN v ON v.g = g.g GROUP BY c.doc_id, c.line),
k AS (SELECT *, list_position(z, list_max(z)) - 1 AS k, 1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p FROM s),
f AS (SELECT doc_id, CASE WHEN p >= {m.least!r} THEN {names}[k + 1] ELSE {_q(UNKNOWN)} END AS family, {best} AS overlap FROM k),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (family <> {_q(UNKNOWN)} AND overlap >= {confirm}) AS sure, count(*) FILTER (family = {_q(UNKNOWN)}) AS unknown, string_agg(DISTINCT family, ',' ORDER BY family) FILTER (family <> {_q(UNKNOWN)} AND overlap >= {confirm}) AS families FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_candidates, coalesce(sure, 0) AS n_licenses, coalesce(unknown, 0) AS n_unknown, coalesce(families, '') AS families FROM documents LEFT JOIN a USING (doc_id)"""


OP12 = """WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM d),
m AS (SELECT doc_id, part, a::INTEGER + 2 * b::INTEGER + 4 * c::INTEGER + 8 * d::INTEGER + 16 * e::INTEGER AS mask FROM f),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
k AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM s v, s w, s x, s y, s z WHERE len(list_distinct([v.f, w.f, x.f, y.f, z.f])) = 5),
p AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS i FROM o)),
g AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost FROM k, p GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""

OP13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS la, b.vec_id AS b, b.label AS lb, list_inner_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, la, b, s FROM s WHERE la = lb QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r FROM p JOIN s ON s.a = p.a AND s.lb <> p.la AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 10"""


ORACLES = {"op1_secrets": op1(), "op2_decontaminate": OP2, "op3_licenses": op3(), "op4_embeddings": OP4, "op5_repeats": OP5, "op12_filter_audit": OP12, "op13_hard_negatives": OP13}
