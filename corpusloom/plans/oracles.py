"""SQL for DuckDB that gives the rows of the registered queries, written apart from the operators."""

from __future__ import annotations

import unicodedata

from ..functions.normalize import PUNCTUATION
from ..functions.scripts import FOREIGN, char_class
from ..operators.mixing import COVERAGE, LANGUAGES, ZULU, ethiopic_block
from .corpus import MERGES_1, MERGES_2, TARGETS

ALL = "al AS (SELECT lang, doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS text FROM (SELECT lang, doc_id, string_split(text, chr(10)) AS p FROM documents))"
LINES = f"{ALL}, l AS (SELECT * FROM al WHERE text <> '')"
WORDS = "w AS (SELECT u AS unit, count(*) AS freq FROM (SELECT unnest(string_split(text, ' ')) AS u FROM l) WHERE u <> '' GROUP BY u)"
LINE_UNITS = "w AS (SELECT text AS unit, count(*) AS freq FROM l GROUP BY text)"
CHARS = "regexp_extract_all(unit, '(?s).')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def named(lang: str | None) -> str:
    return "NULL" if lang is None else q(lang)


def marker_sql(text: str, more: str = "") -> str:
    """A text with its Latin letters beyond ASCII (and ``more``) replaced by what stands for them, controls and runs of white space by one space."""
    out = text
    for c in [*(chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha()), *more]:
        base = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c)).encode("ascii", "ignore").decode()
        if unicodedata.normalize("NFKC", c) == c:
            out = f"replace({out}, {q(c)}, {q(f'{base}[U+{ord(c):04X} {unicodedata.name(c)}]')})"
    for a, b in PUNCTUATION.items():
        out = f"replace({out}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({out}, '[\\x00-\\x20\\x7F]+', ' ', 'g'))"


#: Letters that a combining acute accent makes of letters in front of it, beyond those of marker_sql().
COMPOSED = "".join(c for c in map(chr, [*range(0x180, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.decomposition(c).endswith(" 0301"))
NORMAL = f"n AS (SELECT lang, doc_id, line_no, text, {marker_sql('text')} AS processed FROM l)"
MARKER = r"'\[U\+[0-9A-Fa-f]{4,6} [^\]]+\]'"
FOUND = f"m AS (SELECT lang, doc_id, line_no, unnest(range(len(f))) AS pos, unnest(f) AS marker FROM (SELECT lang, doc_id, line_no, regexp_extract_all(processed, {MARKER}) AS f FROM n))"
INJECTED = f"{ALL}, i AS (SELECT lang, doc_id, line_no, translate(text, 'üöäß', 'жшщю') AS text FROM al)"


def reason_sql(least: int = 3, scripts: tuple[str, ...] = FOREIGN, allowed: tuple[str, ...] = ()) -> str:
    parts = []
    for s in scripts:
        c = char_class(s, allowed)
        hit = f"length(regexp_replace(text, '[^{c[1:]}', '', 'g')) >= {least}"
        parts.append(f"CASE WHEN {hit} THEN {{'at': length(regexp_extract(text, '^[^{c[1:]}*')), 'script': '{s}'}} END")
    return f"CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN list_min(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)).script END"


JUDGED = f"{INJECTED}, j AS (SELECT *, {reason_sql()} AS reason FROM i)"
SCORED = f"{ALL}, s AS (SELECT text, CASE WHEN lang = 'es' THEN 'eo' ELSE lang END AS label, ((length(text) * 37) % 100) / 100 AS prob FROM al), d AS (SELECT *, prob >= 0.5 AND label NOT IN ('sq', 'eo', 'az', 'fi') AND regexp_matches(text, '\\S') AS gone FROM s)"


def registry_sql(rows) -> str:
    values = ", ".join(f"({q(n)}, {b}::BIGINT, {c}::DOUBLE, {e}::DOUBLE, {capped}, {i})" for i, (n, b, c, e, capped) in enumerate(rows))
    return (
        f"g AS (SELECT *, b / c AS raw FROM (VALUES {values}) t(name, b, c, e, capped, i)), h AS (SELECT *, raw * e AS processed, pow(raw * e, 0.1) AS w FROM g), "
        "x AS (SELECT *, w / (SELECT sum(w ORDER BY i) FROM h) AS share FROM h), y AS (SELECT *, 1e8 * share AS target, 1e8 * share / e AS target_raw FROM x)"
    )


STARTS = "o AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY lang ORDER BY doc_id, line_no) - length(text) - 1 AS start FROM {0}), t AS (SELECT lang, sum(length(text) + 1) - 1 AS whole FROM {0} GROUP BY lang)"
SPLIT = STARTS.format("al") + ", p AS (SELECT o.*, CASE WHEN start <= floor(whole * (1 - 0.15)) THEN 'pool' ELSE 'heldout' END AS part FROM o JOIN t ON o.lang IS NOT DISTINCT FROM t.lang)"


def tiled_sql(factor: float, of: str, newline: bool = False) -> str:
    targets = ", ".join(f"({named(k)}, {int(v * factor)})" for k, v in TARGETS)
    return (
        f"{STARTS.format(of)}, tt AS (SELECT t.lang, whole + {int(newline)} AS size, target FROM t JOIN (VALUES {targets}) v(lang, target) ON t.lang IS NOT DISTINCT FROM v.lang), "
        "cc AS (SELECT lang, size, target, unnest(range(((target - 1) // size + 1)::BIGINT)) AS copy FROM tt), "
        "la AS (SELECT lang, max(start) AS last FROM o GROUP BY lang), "
        "k AS (SELECT o.lang, copy, doc_id, line_no, text, copy * size + start AS f, target, start = last AS is_last FROM o JOIN cc ON o.lang IS NOT DISTINCT FROM cc.lang JOIN la ON o.lang IS NOT DISTINCT FROM la.lang WHERE copy * size + start < target), "
        "z AS (SELECT lang, copy, doc_id, line_no, substring(text, 1, (target - f)::BIGINT) AS text, is_last AND f + length(text) < target AS fused FROM k)"
    )


def base_sql() -> str:
    """The ids of characters: printable ASCII by code, others behind it in the order of their codes."""
    return (
        f"c0 AS (SELECT DISTINCT unnest({CHARS}) AS c FROM w), nb AS (SELECT c, 94 + row_number() OVER (ORDER BY unicode(c)) AS id FROM c0 WHERE unicode(c) NOT BETWEEN 32 AND 126), "
        "ids AS (SELECT c, id FROM nb UNION ALL SELECT chr((i + 32)::INTEGER), i FROM range(95) r(i)), mp AS (SELECT map(list(c), list('<' || id || '>')) AS m, 95 + (SELECT count(*) FROM nb) AS n0 FROM ids), "
        f"u0 AS (SELECT array_to_string(list_transform({CHARS}, lambda c: m[c]), '') AS seq, freq AS f FROM w, mp)"
    )


PAIRS = "SELECT unnest(ids[1:len(ids)-1]) AS a, unnest(ids[2:]) AS b, f FROM (SELECT list_transform(string_split(seq[2:len(seq)-1], '><'), lambda x: x::INTEGER) AS ids, f FROM {0}) WHERE len(ids) > 1"


def learned_sql(name: str, source: str, first: str, merges: int, where: str = "true") -> str:
    """A recursive table (k, seq, f, a, b): the units after k merges, of which the last was (a, b)."""
    return (
        f"{name}(k, seq, f, a, b) AS (SELECT 0, seq, f, NULL::INTEGER, NULL::INTEGER FROM {source} UNION ALL SELECT k + 1, replace(seq, '<' || x.a || '><' || x.b || '>', '<' || (({first}) + k) || '>'), f, x.a, x.b "
        f"FROM {name}, (SELECT a, b FROM ({PAIRS.format(name)}) WHERE {where} GROUP BY a, b ORDER BY sum(f) DESC, a, b LIMIT 1) x WHERE k < {merges})"
    )


N0 = "SELECT n0 FROM mp"


def merges_sql(name: str, first: str) -> str:
    return f"SELECT (k - 1)::BIGINT AS rank, any_value(a)::BIGINT AS a, any_value(b)::BIGINT AS b, (({first}) + k - 1)::BIGINT AS new_id FROM {name} WHERE k > 0 GROUP BY k"


#: How many ids, of a text like <1><2>, are in a set like <0><99>; and the ids that hold a space, by the merges so far.
def count_in(seq: str, ids: str) -> str:
    return f"len(list_filter(string_split({seq}[2:len({seq})-1], '><'), lambda t: contains({ids}, '<' || t || '>')))"


SPACED = "list_reduce(list_prepend('<0>', pl), lambda x, y: x || CASE WHEN contains(x, '<' || split_part(y, '|', 1) || '>') OR contains(x, '<' || split_part(y, '|', 2) || '>') THEN '<' || split_part(y, '|', 3) || '>' ELSE '' END)"
#: Tables r1 and r2: stage 1 on words, stage 2 on lines as stage 1 leaves them; mm: all merges as pattern and replacement.
STAGE_1 = f"{LINES}, {WORDS}, {base_sql()}, {learned_sql('r1', 'u0', N0, MERGES_1)}, m1 AS ({merges_sql('r1', N0)}), ml AS (SELECT list('<' || a || '><' || b || '>|<' || new_id || '>' ORDER BY rank) AS ms FROM m1)"
APPLIED = "list_reduce(list_prepend({0}, ms), lambda x, y: replace(x, split_part(y, '|', 1), split_part(y, '|', 2)))"
CODED = f"array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: m[c]), '')"
STAGE_2 = (
    f"{STAGE_1}, dl AS (SELECT text, count(*) AS f FROM l GROUP BY text), u1 AS (SELECT {APPLIED.format(CODED)} AS seq, f FROM dl, mp, ml), "
    f"{learned_sql('r2', 'u1', f'SELECT n0 + {MERGES_1} FROM mp', MERGES_2)}, m2 AS ({merges_sql('r2', f'SELECT n0 + {MERGES_1} FROM mp')}), "
    "mz AS (SELECT list('<' || a || '><' || b || '>|<' || new_id || '>' ORDER BY new_id) AS ms FROM (FROM m1 UNION ALL FROM m2))"
)
#: ml2: merges as a|b|new; cs: ids that hold a space.
CROSSING = f"pm AS (SELECT list(a || '|' || b || '|' || new_id ORDER BY new_id) AS pl FROM (FROM m1 UNION ALL FROM m2)), cs AS (SELECT {SPACED} AS spaced FROM pm)"
ENCODED = f"{STAGE_2}, e AS (SELECT lang, doc_id, line_no, text, {APPLIED.format(CODED)} AS seq FROM l, mp, mz)"
TOKENS = "len(string_split(seq, '<')) - 1"
BY_LANG = f"SELECT lang, sum({TOKENS})::BIGINT AS tokens, sum(length(text))::BIGINT AS chars, count(*) AS n FROM e GROUP BY lang"


#: Lines coded by a share of the merges, from m1 and m2: of all, of stage 1, of the first so many.
def coded_by(name: str, which: str, source: str = "l", columns: str = "lang, text") -> str:
    return (
        f"{name}z AS (SELECT coalesce(list('<' || a || '><' || b || '>|<' || new_id || '>' ORDER BY new_id), []) AS ms FROM (FROM m1 UNION ALL FROM m2), mp WHERE {which}), "
        f"{name} AS (SELECT {columns}, {APPLIED.format(CODED)} AS seq FROM {source}, mp, {name}z)"
    )


def span_capped_sql(merges: int) -> str:
    """Learning on lines where no symbol may hold two spaces: ids with one are carried along."""
    pairs = "SELECT unnest(ids[1:len(ids)-1]) AS a, unnest(ids[2:]) AS b, f, one FROM (SELECT list_transform(string_split(seq[2:len(seq)-1], '><'), lambda x: x::INTEGER) AS ids, f, one FROM r1) WHERE len(ids) > 1"
    has = lambda x: f"contains(one, '<' || {x} || '>')"
    return (
        "r1(k, seq, f, a, b, one) AS (SELECT 0, seq, f, NULL::INTEGER, NULL::INTEGER, '<0>' FROM u0 UNION ALL "
        f"SELECT k + 1, replace(seq, '<' || x.a || '><' || x.b || '>', '<' || (({N0}) + k) || '>'), f, x.a, x.b, one || CASE WHEN {has('x.a')} OR {has('x.b')} THEN '<' || (({N0}) + k) || '>' ELSE '' END "
        f"FROM r1, (SELECT a, b FROM ({pairs}) WHERE NOT ({has('a')} AND {has('b')}) GROUP BY a, b ORDER BY sum(f) DESC, a, b LIMIT 1) x WHERE k < {merges})"
    )


def pmi_sql(merges: int, least: int, every: int) -> str:
    """Learning by PMI: candidates are those listed ``every`` merges ago or less whose score has not moved since; where none is left they are listed anew."""

    def scored(seq: str) -> str:
        ids = f"SELECT list_transform(string_split({seq}[2:len({seq})-1], '><'), lambda x: x::INTEGER) AS ids, f FROM r1"
        return (
            f"(SELECT a, b, n, ln(n) - ln(na) - ln(nb) AS pmi FROM (SELECT a, b, sum(f) AS n FROM (SELECT unnest(ids[1:len(ids)-1]) AS a, unnest(ids[2:]) AS b, f FROM ({ids}) WHERE len(ids) > 1) GROUP BY a, b) "
            f"JOIN (SELECT s AS a, sum(f) AS na FROM (SELECT unnest(ids) AS s, f FROM ({ids})) GROUP BY s) USING (a) JOIN (SELECT s AS b, sum(f) AS nb FROM (SELECT unnest(ids) AS s, f FROM ({ids})) GROUP BY s) USING (b) WHERE n >= {least})"
        )

    best = (
        f"SELECT a, b, late FROM (SELECT c.a, c.b, 0 AS late, o.pmi FROM {scored('seq')} c JOIN {scored('listed')} o ON o.a = c.a AND o.b = c.b AND abs(o.pmi - c.pmi) <= 1e-9 "
        f"UNION ALL SELECT a, b, 1 AS late, pmi FROM {scored('seq')}) ORDER BY late, pmi DESC, a, b LIMIT 1"
    )
    new = f"replace(seq, '<' || x.a || '><' || x.b || '>', '<' || (({N0}) + k) || '>')"
    age = "CASE WHEN late = 1 THEN 1 ELSE age + 1 END"
    return (
        "r1(k, age, seq, listed, f, a, b) AS (SELECT 0, 0, seq, seq, f, NULL::INTEGER, NULL::INTEGER FROM u0 UNION ALL "
        f"SELECT k + 1, CASE WHEN {age} >= {every} THEN 0 ELSE {age} END, {new}, CASE WHEN {age} >= {every} THEN {new} WHEN late = 1 THEN seq ELSE listed END, f, x.a, x.b FROM r1, ({best}) x WHERE k < {merges})"
    )


#: The strings of a vocabulary, built up merge by merge in one text of entries; characters 1 to 3 set them apart.
def vocabulary_sql(side: str, where: str, merges: int) -> str:
    """Table {side}: strings of the merges learned from the normalised words of some languages."""
    learned = f"{base_sql()}, {learned_sql('r1', 'u0', N0, merges)}, m1 AS ({merges_sql('r1', N0)})"
    entry = lambda i: f"split_part(split_part(x, chr(1) || {i} || chr(2), 2), chr(3), 1)"
    a, b, n = (f"split_part(y, '|', {i})" for i in (1, 2, 3))
    grown = f"list_reduce(list_prepend(al0, pl), lambda x, y: x || chr(1) || {n} || chr(2) || {entry(a)} || {entry(b)} || chr(3))"
    body = (
        f"WITH RECURSIVE w AS (SELECT u AS unit, count(*) AS freq FROM (SELECT unnest(string_split(processed, ' ')) AS u FROM n WHERE {where}) WHERE u <> '' GROUP BY u), {learned}, "
        "pm AS (SELECT list(a || '|' || b || '|' || new_id ORDER BY rank) AS pl, list(new_id) AS ids FROM m1), a0 AS (SELECT string_agg(chr(1) || id || chr(2) || c || chr(3), '' ORDER BY id) AS al0 FROM ids), "
        f"g AS (SELECT {grown} AS x, ids FROM pm, a0) SELECT {entry('i')} AS str FROM (SELECT x, unnest(ids) AS i FROM g)"
    )
    return f"{side} AS ({body})"


def vocab_diff_sql(merges: int, containing: str) -> str:
    def only(a: str, b: str, name: str) -> str:
        return f"(SELECT '{name}' AS side, str FROM (SELECT DISTINCT str FROM {a} WHERE str NOT IN (SELECT str FROM {b})) WHERE contains(str, {q(containing)}) ORDER BY length(str) DESC, str LIMIT 25)"

    sides = f"{vocabulary_sql('old', 'lang = ' + q('en'), merges)}, {vocabulary_sql('new', 'lang <> ' + q('en'), merges)}"
    return f"WITH {LINES}, {NORMAL}, {sides} {only('old', 'new', 'lost')} UNION ALL {only('new', 'old', 'gained')}"


def langid_sql(per_label: int = 400, most: int = 3000) -> str:
    """The n-gram scorer: trained on the lines with the first hashes, and the label of each line by the sum of log probabilities."""
    grams = "list_concat(list_concat(list_transform(range(1, len(t) + 1), lambda i: t[i:i]), list_transform(range(1, len(t)), lambda i: t[i:i + 1])), list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2]))"
    padded = r"' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' '"
    return (
        f"WITH {LINES}, s AS (SELECT lang, text FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY md5(text), text) AS rn FROM (SELECT DISTINCT lang, text FROM l)) WHERE rn <= {per_label}), "
        f"sg AS (SELECT lang, g, count(*) AS c FROM (SELECT lang, unnest({grams}) AS g FROM (SELECT lang, {padded} AS t FROM s)) GROUP BY lang, g), "
        f"k AS (SELECT g FROM sg GROUP BY g ORDER BY sum(c) DESC, g LIMIT {most}), ll AS (SELECT DISTINCT lang AS label FROM s), "
        "pc AS (SELECT label, g, coalesce(c, 0) + 0.5 AS v FROM ll CROSS JOIN k LEFT JOIN (SELECT lang AS label, g, c FROM sg) USING (label, g)), "
        "p AS (SELECT label, g, ln(v::DOUBLE / sum(v::DOUBLE) OVER (PARTITION BY label)) AS lp FROM pc), "
        f"lg AS (SELECT doc_id, line_no, g, count(*) AS c FROM (SELECT doc_id, line_no, unnest({grams}) AS g FROM (SELECT doc_id, line_no, {padded} AS t FROM l WHERE regexp_matches(text, '[^\\s]'))) GROUP BY ALL), "
        "sc AS (SELECT doc_id, line_no, label, sum(c * lp) AS z FROM lg JOIN p USING (g) GROUP BY doc_id, line_no, label), "
        "b AS (SELECT doc_id, line_no, arg_min(label, (-z, label)) AS label FROM sc GROUP BY doc_id, line_no) "
        "SELECT lang, label, count(*) AS n FROM l LEFT JOIN b USING (doc_id, line_no) GROUP BY lang, label"
    )


#: The first 500 bytes: whole characters, and one mark if the cut is within one.
SAMPLE_TRIM = """WITH c AS (SELECT doc_id, text, list_transform(string_split(text[1:500], ''), lambda x: octet_length(encode(x))) AS w FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, text, len(list_filter(range(1, len(w) + 1), lambda i: list_sum(w[1:i]) <= 500)) AS k, w FROM c),
h AS (SELECT doc_id, text[1:k] || CASE WHEN octet_length(encode(text)) > 500 AND octet_length(encode(text[1:k])) < 500 THEN chr(65533) ELSE '' END AS h FROM n),
t AS (SELECT doc_id, CASE WHEN NOT contains(h, chr(10)) THEN h WHEN length(h) - instr(reverse(h), chr(10)) + 1 > 1 THEN h[1:length(h) - instr(reverse(h), chr(10))] ELSE h END AS t FROM h)
SELECT doc_id, length(t) AS n_chars, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines FROM t UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL"""


def rec(body: str) -> str:
    return f"WITH RECURSIVE {body}"


ORACLES = {
    "q_lines_nonempty": f"WITH {LINES} SELECT lang, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM l GROUP BY lang",
    "q_word_freq_top": f"WITH {LINES}, {WORDS} SELECT unit, freq FROM w ORDER BY freq DESC, unit LIMIT 100",
    "q_line_freq": f"WITH {LINES}, {LINE_UNITS} SELECT unit, freq FROM w WHERE freq > 1",
    "q_pair_counts_top": f"WITH {LINES}, {WORDS}, x AS (SELECT {CHARS} AS c, freq FROM w), p AS (SELECT unnest(c[1:len(c)-1]) AS a, unnest(c[2:]) AS b, freq FROM x WHERE len(c) > 1) SELECT a, b, sum(freq)::BIGINT AS n FROM p GROUP BY a, b ORDER BY n DESC, a, b LIMIT 100",
    "q_symbol_counts": f"WITH {LINES}, {WORDS} SELECT symbol, sum(freq)::BIGINT AS n FROM (SELECT unnest({CHARS}) AS symbol, freq FROM w) GROUP BY symbol",
    "q_fingerprint": f"WITH {LINES}, {WORDS} SELECT count(*) || ':' || sum(freq) || ':' || sum(length(unit) * freq) AS fingerprint FROM w",
    "q_normalize_lines": f"WITH {LINES}, {NORMAL} SELECT doc_id, line_no, processed AS text FROM n",
    "q_expansion_by_lang": f"WITH {LINES}, {NORMAL} SELECT lang, sum(length(text))::BIGINT AS raw_chars, sum(length(processed))::BIGINT AS processed_chars, sum(length(processed))::DOUBLE / greatest(sum(length(text)), 1)::DOUBLE AS expansion_factor FROM n GROUP BY lang",
    "q_marker_fraction": f"WITH {LINES}, {NORMAL}, {FOUND}, s AS (SELECT lang, sum(length(processed)) AS c FROM n GROUP BY lang), y AS (SELECT lang, count(DISTINCT marker) AS u, sum(length(marker)) AS z FROM m GROUP BY lang) "
    "SELECT lang, coalesce(u, 0)::BIGINT AS unique_markers, coalesce(z, 0)::DOUBLE / greatest(c, 1)::DOUBLE AS marker_char_fraction FROM s LEFT JOIN (SELECT lang AS its_lang, u, z FROM y) ON lang IS NOT DISTINCT FROM its_lang",
    "q_marker_counts": f"WITH {LINES}, {NORMAL}, {FOUND} SELECT lang, marker, count(*) AS n FROM m GROUP BY ALL",
    "q_markers_top15": f"WITH {LINES}, {NORMAL}, {FOUND}, x AS (SELECT lang, marker, count(*) AS n, min((doc_id, line_no, pos)) AS f FROM m GROUP BY lang, marker) SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank, marker, n FROM x) WHERE rank <= 15",
    "q_markers_rare": f"WITH {LINES}, {NORMAL}, {FOUND} SELECT lang, marker, count(*) AS n FROM m GROUP BY lang, marker HAVING count(*) < 20",
    "q_script_filter_stats": f"WITH {JUDGED}, x AS (SELECT lang, count(*) AS total_lines, count(reason) AS dropped_lines, sum(length(text) + 1)::BIGINT AS total_chars, coalesce(sum(length(text) + 1) FILTER (reason IS NOT NULL), 0)::BIGINT AS dropped_chars FROM j GROUP BY lang) "
    "SELECT *, 100.0::DOUBLE * dropped_lines / greatest(total_lines, 1) AS pct_lines, 100.0::DOUBLE * dropped_chars / greatest(total_chars, 1) AS pct_chars FROM x",
    "q_script_filter_kept": f"WITH {JUDGED} SELECT doc_id, line_no, text FROM j WHERE reason IS NULL",
    "q_script_drop_reasons": f"WITH {JUDGED} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason",
    "q_line_examples": f"WITH {JUDGED} SELECT lang, doc_id, line_no, reason, trim(text)[:160] AS example FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS rn FROM j WHERE reason IS NOT NULL) WHERE rn <= 2",
    "q_langid_filter": f"WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (gone) AS dropped, 100.0::DOUBLE * count(*) FILTER (gone) / greatest(count(*), 1) AS pct FROM d",
    "q_langid_dropped": f"WITH {SCORED} SELECT label, count(*) AS n FROM d WHERE gone GROUP BY label ORDER BY n DESC, label LIMIT 15",
    "q_mix_shares": f"WITH {registry_sql(LANGUAGES)} SELECT name, round(processed, 3) AS natural_processed_chars, round(share, 9) AS share FROM y",
    "q_mix_targets": f"WITH {registry_sql([*LANGUAGES[:8], ZULU, *LANGUAGES[8:]])} SELECT name, round(target, 3) AS target_processed, trunc(target_raw)::BIGINT AS target_raw_chars FROM y",
    "q_upsample_notes": f"WITH {registry_sql(LANGUAGES)} SELECT name, round(target_raw / raw, 6) AS repeat_factor, CASE WHEN target_raw / raw > 1 THEN CASE WHEN capped THEN 'MUST repeat' ELSE 'would need more than downloaded' END ELSE '' END AS note FROM y",
    "q_split_pool_heldout": f"WITH {ALL}, {SPLIT} SELECT lang, doc_id, line_no, part FROM p",
    "q_slice_prefix": f"WITH {ALL}, {tiled_sql(0.5, 'al')} SELECT lang, copy, doc_id, line_no, text FROM z",
    "q_tile_pool": f"WITH {ALL}, {tiled_sql(2.5, 'al')} SELECT lang, count(*) AS n_lines, max(copy) AS last_copy, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (fused) AS n_fused FROM z GROUP BY lang",
    "q_assemble": f"WITH {ALL}, {SPLIT.replace('o AS', 'o1 AS').replace('FROM o ', 'FROM o1 ').replace('t AS (', 't1 AS (').replace('JOIN t ', 'JOIN t1 ').replace('o.*', 'o1.*').replace('o.lang', 'o1.lang').replace('t.lang', 't1.lang')}, pl AS (SELECT lang, doc_id, line_no, text FROM p WHERE part = 'pool'), {tiled_sql(1.0, 'pl', True)}, n AS (SELECT lang, copy, doc_id, line_no, {marker_sql('text')} AS processed FROM z) "
    "SELECT lang, copy, doc_id, line_no, processed AS text FROM n WHERE processed <> ''",
    "q_coverage_supplement": "SELECT lang, len(cs)::BIGINT AS num_codepoints, array_to_string(flatten(list_transform(cs, lambda c: [w(c), w(c)])), ' ') AS supplement FROM (VALUES ".replace(
        "[w(c), w(c)]", "list_transform([1, 2], lambda i: 'a' || c || 'b ' || c || 'a ' || c || c)"
    )
    + ", ".join(f"({q(a)}, [{', '.join(map(q, c))}]::VARCHAR[])" for a, _, _, d in COVERAGE for c in [ethiopic_block() if d is None else d])
    + ") t(lang, cs)",
    "q_coverage_union": "SELECT count(DISTINCT c) AS n_codepoints FROM (VALUES " + ", ".join(f"({ord(c)})" for _, _, _, d in COVERAGE for c in (ethiopic_block() if d is None else d)) + ") t(c)",
    "q_bpe_merges_50": rec(f"{LINES}, {WORDS}, {base_sql()}, {learned_sql('r1', 'u0', N0, 50)} {merges_sql('r1', N0)}"),
    "q_bpe_stage2_merges": rec(f"{STAGE_2} SELECT (rank)::BIGINT AS rank, a, b, new_id FROM m2"),
    "q_encode_lines": rec(f"{ENCODED} SELECT doc_id, line_no, replace(seq[2:len(seq)-1], '><', ' ') AS ids FROM e"),
    "q_encode_native": rec(f"{ENCODED} SELECT lang, tokens FROM ({BY_LANG})"),
    "q_encode_tokens_by_lang": rec(f"{ENCODED} SELECT lang, tokens, chars, tokens / chars AS tokens_per_char FROM ({BY_LANG})"),
    "q_compression_blob": rec(f"{ENCODED} SELECT lang, tokens + n - 1 AS tokens, chars + n - 1 AS chars, (tokens + n - 1) / (chars + n - 1) AS tokens_per_char FROM ({BY_LANG})"),
    "q_compression_rollup": rec(f"{ENCODED} SELECT CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, sum(tokens)::BIGINT AS tokens, sum(chars)::BIGINT AS chars, sum(tokens)::BIGINT / sum(chars)::BIGINT AS tokens_per_char FROM ({BY_LANG}) GROUP BY ROLLUP (lang)"),
    "q_worst_lang": rec(f"{ENCODED} SELECT lang, tokens / chars AS tokens_per_char FROM ({BY_LANG}) ORDER BY 2 DESC, lang LIMIT 1"),
    "q_roundtrip": f"WITH {LINES} SELECT count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, 0::BIGINT AS n_mismatch, NULL::BIGINT AS first_doc, NULL::BIGINT AS first_line FROM l",
    "q_codec_baseline": f"WITH {LINES} SELECT lang, sum(length(text) + 1)::BIGINT AS n_ids, sum(list_sum(list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) + 1)))::BIGINT AS sum_ids, 0::BIGINT AS n_mismatch FROM l GROUP BY lang",
    "q_tpch_rollup": "SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS sum_price, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "q_events_tumbling": "SELECT event_type, count(*) AS n_windows, max(n) AS most, sum(n)::BIGINT AS n FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
}
ORACLES["q_bpe_merges_distributed"] = ORACLES["q_bpe_merges_50"]
ORACLES["q_bpe_span_capped"] = rec(f"{LINES}, {LINE_UNITS}, {base_sql()}, {span_capped_sql(20)} {merges_sql('r1', N0)}")
ORACLES["q_pmi_merges"] = rec(f"{LINES}, {WORDS}, {base_sql()}, {pmi_sql(30, 500, 10)} {merges_sql('r1', N0)}")
ORACLES["q_crossing_pct"] = rec(
    f"{ENCODED}, {CROSSING} SELECT lang, sum({count_in('seq', 'spaced')})::BIGINT AS crossing, 100.0::DOUBLE * sum({count_in('seq', 'spaced')})::BIGINT / greatest(sum({TOKENS}), 1)::BIGINT AS crossing_pct FROM e, cs GROUP BY lang"
)
ORACLES["q_tier2_report"] = rec(
    f"{STAGE_2}, {CROSSING}, k AS (SELECT role AS lang, unnest(string_split(text, chr(10))) AS text FROM conversations), kl AS (SELECT * FROM k WHERE text <> ''), "
    f"e AS (SELECT lang, text, {APPLIED.format(CODED.replace('m[c]', "coalesce(m[c], '<-1>')"))} AS seq FROM kl, mp, mz), "
    f"t AS (SELECT lang, sum({TOKENS})::BIGINT AS tokens, sum(length(text))::BIGINT AS chars, sum({count_in('seq', 'spaced')})::BIGINT AS x FROM e, cs GROUP BY lang) "
    "SELECT lang, CASE lang WHEN 'user' THEN 'asks' ELSE '' END AS mirror, tokens, chars, 100.0::DOUBLE * x / greatest(tokens, 1) AS crossing_pct FROM t"
)
_CONFIGS = {"base": "true", "words": f"new_id < n0 + {MERGES_1}", "half": f"new_id < n0 + {MERGES_1 - MERGES_1 // 2}"}
ORACLES["q_config_vs_baseline"] = rec(
    f"{STAGE_2}, {', '.join(coded_by(f'e_{k}', w) for k, w in _CONFIGS.items())}, "
    f"v AS ({' UNION ALL '.join(f"SELECT '{k}' AS config, CASE WHEN grouping(lang) = 1 THEN 'BLENDED' ELSE lang END AS lang, sum({TOKENS})::BIGINT / greatest(sum(length(text)), 1)::BIGINT AS value FROM e_{k} GROUP BY ROLLUP (lang)" for k in _CONFIGS)}), "
    "b AS (SELECT lang, value AS base FROM v WHERE config = 'base'), p AS (SELECT config, v.lang, value, CASE WHEN config <> 'base' AND base > 0 THEN 100.0::DOUBLE * (value - base) / base ELSE 0.0::DOUBLE END AS pct FROM v JOIN b ON v.lang IS NOT DISTINCT FROM b.lang) "
    "SELECT config, lang, value, pct, CASE WHEN pct > 5 THEN '!!' ELSE '' END AS flag FROM p"
)
_SIZES = {-MERGES_1 - MERGES_2: ("1", "false"), -MERGES_2: ("1", f"new_id < n0 + {MERGES_1}"), 0: ("2", "true")}
_SPLIT = SPLIT.replace("FROM al", "FROM l").replace("o AS", "so AS").replace("FROM o ", "FROM so ").replace("o.*", "so.*").replace("t AS (", "st AS (").replace("JOIN t ", "JOIN st ").replace("p AS (", "sp AS (").replace("o.lang", "so.lang").replace("t.lang", "st.lang")
ORACLES["q_training_curve"] = rec(
    f"{STAGE_2}, {_SPLIT}, {', '.join(coded_by(f'e{i}', w, 'sp', 'lang, part, text') for i, (_, w) in enumerate(_SIZES.values()))} "
    + " UNION ALL ".join(
        f"SELECT {stage} AS stage, {v}::BIGINT AS vocab_offset, CASE part WHEN 'pool' THEN 'train' ELSE part END AS split, CASE WHEN grouping(lang) = 1 THEN 'ALL' ELSE lang END AS lang, sum({TOKENS})::BIGINT / greatest(sum(length(text)), 1)::BIGINT AS tokens_per_char FROM e{i} GROUP BY GROUPING SETS ((part, lang), (part))"
        for i, (v, (stage, _)) in enumerate(_SIZES.items())
    )
)
def _marked(c: str) -> str:
    """A code point of the coverage registry as normalisation leaves it."""
    c = unicodedata.normalize("NFKC", c)
    out = "".join(PUNCTUATION.get(x) or unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode() + f"[U+{ord(x):04X} {unicodedata.name(x)}]" for x in c)
    return out


_COVERED = [(a, c) for a, _, _, d in COVERAGE for c in (ethiopic_block() if d is None else d)]
_JOBS = {"amharic": 5, "hausa": 5, "somali": 5, "swahili": 5, "yoruba": 5, "igbo": 5, "kinyarwanda": 5, "xhosa": 45, "zulu": 8}
ORACLES["q_lines_nonblank"] = f"WITH {ALL} SELECT lang, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars FROM al WHERE regexp_matches(text, '[^\\s]') GROUP BY lang"
ORACLES["q_sample_jobs"] = "SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {v}000000::BIGINT)" for k, v in _JOBS.items()) + ") t(lang, n_bytes)"
ORACLES["q_slugs"] = (
    "SELECT name, 'raw/' || replace(lower(name), ' ', '_') || '.txt' AS path, NULL::VARCHAR AS slug FROM (VALUES " + ", ".join(f"({q(x[0])})" for x in [*LANGUAGES, ZULU]) + ") t(name) "
    "UNION ALL SELECT name, NULL, split_part(split_part(lower(name), ' ', 1), '(', 1) FROM (VALUES " + ", ".join(f"({q(a)})" for a, *_ in COVERAGE) + ") t(name)"
)
ORACLES["q_coverage_manifest"] = "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(c)}, {q((chr(92) + 'x%02x' if ord(c) < 256 else chr(92) + 'u%04x') % ord(c))}, {q(_marked(c))})" for a, c in _COVERED) + ") t(lang, char, char_escaped, marker)"
ORACLES["q_strict_filter"] = (
    f"WITH {ALL}, i AS (SELECT doc_id, line_no, translate(text, 'éñç', 'ሀሁሂ') AS text FROM al) "
    f"SELECT * FROM (SELECT doc_id, line_no, {reason_sql(3, (*FOREIGN, 'ETHIOPIC'))} AS strict, {reason_sql()} AS usual FROM i) WHERE strict IS NOT NULL OR usual IS NOT NULL"
)
_TARGETS = ", ".join(f"({named(k)}, {v}::BIGINT)" for k, v in TARGETS)
ORACLES["q_assembly_report"] = f"WITH {ALL}, {SPLIT}, pc AS (SELECT lang, sum(length(text) + 1)::BIGINT - 1 AS pool_chars FROM p WHERE part = 'pool' GROUP BY lang) SELECT v.lang, target, coalesce(pool_chars, 0) AS pool_chars, target > coalesce(pool_chars, 0) AS upsampled FROM (VALUES {_TARGETS}) v(lang, target) LEFT JOIN pc ON v.lang IS NOT DISTINCT FROM pc.lang"
ORACLES["q_spot_check"] = rec(f"{ENCODED} SELECT lang, doc_id, line_no, {TOKENS} AS tokens, true AS same FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS rn FROM e) WHERE rn <= 20")
_STRINGS = "list_reduce(list_prepend(al0, pl), lambda x, y: x || chr(1) || split_part(y, '|', 3) || chr(2) || split_part(split_part(x, chr(1) || split_part(y, '|', 1) || chr(2), 2), chr(3), 1) || split_part(split_part(x, chr(1) || split_part(y, '|', 2) || chr(2), 2), chr(3), 1) || chr(3))"
# a combining mark joins the letter in front of it, where there is such a letter; the texts are joined by DuckDB's own normal form first
ORACLES["q_normalize_mixed"] = f"WITH {LINES}, t AS (SELECT doc_id, line_no, nfc_normalize(translate(text, 'üöäßéñó', 'ሀж።“́ǃ…')) AS text FROM l) SELECT doc_id, line_no, {marker_sql('text', 'ሀжǃ' + chr(0x301) + COMPOSED)} AS text FROM t"
ORACLES["q_validation"] = "SELECT unnest(['vocab_size', 'types', 'edge_cases', 'losslessness', 'passed']) AS name, true AS holds"
ORACLES["q_tokenised_sample"] = rec(
    f"{STAGE_2}, {', '.join(coded_by(f'e_{k}', w, 'l', 'lang, doc_id, line_no, text') for k, w in {'all': 'true', 'words': f'new_id < n0 + {MERGES_1}'}.items())}, "
    f"pm AS (SELECT list(a || '|' || b || '|' || new_id ORDER BY new_id) AS pl FROM (FROM m1 UNION ALL FROM m2)), a0 AS (SELECT string_agg(chr(1) || id || chr(2) || c || chr(3), '' ORDER BY id) AS al0 FROM ids), g AS (SELECT {_STRINGS} AS x FROM pm, a0), "
    "f AS (" + " UNION ALL ".join(f"SELECT lang, '{k}' AS config, arg_min(seq, (doc_id, line_no)) AS seq FROM e_{k} GROUP BY lang" for k in ("all", "words")) + ") "
    f"SELECT lang, config, {TOKENS} AS tokens, split_part(split_part(x, chr(1) || string_split(seq[2:len(seq)-1], '><')[1] || chr(2), 2), chr(3), 1) AS first FROM f, g"
)
ORACLES["q_corpus_files"] = ORACLES["q_lines_nonempty"]
ORACLES["q_model_vocabulary"] = rec(
    f"{STAGE_2}, pm AS (SELECT list(a || '|' || b || '|' || new_id ORDER BY new_id) AS pl, list(new_id) AS ids FROM (FROM m1 UNION ALL FROM m2)), a0 AS (SELECT string_agg(chr(1) || id || chr(2) || c || chr(3), '' ORDER BY id) AS al0 FROM ids), "
    f"g AS (SELECT {_STRINGS} AS x, ids FROM pm, a0) SELECT i AS id, str, length(str) - length(replace(str, ' ', '')) AS n_spaces FROM (SELECT i, split_part(split_part(x, chr(1) || i || chr(2), 2), chr(3), 1) AS str FROM (SELECT x, unnest(ids) AS i FROM g))"
)
ORACLES["q_snapshot_merges"] = rec(f"{STAGE_1} SELECT rank, a, b, new_id FROM m1 WHERE rank < 25")
ORACLES["q_resumed_merges"] = rec(f"{STAGE_1} SELECT rank, a, b, new_id FROM m1")
ORACLES["q_one_stage_tokens"] = rec(
    f"{STAGE_1}, ow AS (SELECT lang, unnest(string_split(text, ' ')) AS text FROM l), e AS (SELECT lang, text, {APPLIED.format(CODED)} AS seq FROM ow, mp, ml) "
    f"SELECT lang, sum(CASE WHEN text = '' THEN 0 ELSE {TOKENS} END)::BIGINT AS tokens, sum(length(text))::BIGINT + count(*) - 1 AS chars FROM e GROUP BY lang"
)
ORACLES["q_sql_functions"] = rec(
    f"{ENCODED}, {NORMAL} SELECT lang, n_processed, tokens, 0::BIGINT AS n_mismatch FROM (SELECT lang, sum(length(processed))::BIGINT AS n_processed FROM n GROUP BY lang) JOIN (SELECT lang AS by_lang, tokens FROM ({BY_LANG})) ON lang IS NOT DISTINCT FROM by_lang"
)
ORACLES["q_bpe_tokens"] = rec(f"{ENCODED}, f AS (SELECT lang, arg_min(seq, (doc_id, line_no)) AS seq FROM e GROUP BY lang), x AS (SELECT lang, string_split(seq[2:len(seq)-1], '><') AS ids FROM f) SELECT lang, unnest(range(len(ids))) AS place, unnest(ids)::BIGINT AS id FROM x")
ORACLES["q_encode_by_words"] = rec(f"{STAGE_1}, dl AS (SELECT text, count(*) AS f FROM l GROUP BY text), u1 AS (SELECT text, {APPLIED.format(CODED)} AS seq, f FROM dl, mp, ml) SELECT text AS unit, f AS freq, replace(seq[2:len(seq)-1], '><', ' ') AS ids FROM u1")
ORACLES["q_script_filter_once"] = (
    f"WITH {JUDGED}, x AS (SELECT count(*) FILTER (reason IS NULL) AS kept_lines, sum(length(text)) FILTER (reason IS NULL)::BIGINT AS kept_chars, count(*) AS total_lines, count(reason) AS dropped_lines, sum(length(text) + 1)::BIGINT AS total_chars, "
    "coalesce(sum(length(text) + 1) FILTER (reason IS NOT NULL), 0)::BIGINT AS dropped_chars FROM j), r AS (SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason) "
    "SELECT *, 100.0::DOUBLE * dropped_lines / greatest(total_lines, 1) AS pct_lines, 100.0::DOUBLE * dropped_chars / greatest(total_chars, 1) AS pct_chars, (SELECT coalesce(string_agg(reason || ':' || n, ',' ORDER BY n DESC, reason), '') FROM r) AS reasons FROM x"
)
ORACLES["q_token_counts"] = rec(f"{ENCODED} SELECT lang, id, count(*) AS n FROM (SELECT lang, unnest(string_split(seq[2:len(seq)-1], '><'))::BIGINT AS id FROM e) GROUP BY lang, id")


def alignment_sql(merges: int) -> str:
    """Ends of tokens in lines by the shared vocabulary and by one of words alone, and those that both have."""
    sizes = lambda name, of: f"{name} AS (SELECT list_reduce(list_prepend(list_transform(range(n0), lambda i: 1::BIGINT), ps), lambda x, y: list_append(x, x[y[1] + 1] + x[y[2] + 1])) AS len FROM (SELECT list([a, b] ORDER BY new_id) AS ps FROM ({of})), mp)"
    tokens = lambda name, merges, lens: (
        f"{name} AS (SELECT lang, doc_id, line_no, n, sum(n) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS e FROM (SELECT lang, doc_id, line_no, i, len[ids[i] + 1] AS n FROM "
        f"(SELECT lang, doc_id, line_no, ids, unnest(range(1, len(ids) + 1)) AS i FROM (SELECT lang, doc_id, line_no, list_transform(string_split(seq[2:len(seq)-1], '><'), lambda t: t::BIGINT) AS ids FROM "
        f"(SELECT lang, doc_id, line_no, {APPLIED.format(CODED)} AS seq FROM l, mp, {merges}))), {lens}))"
    )
    return rec(
        f"{STAGE_2}, {learned_sql('r3', 'u0', N0, merges)}, m3 AS ({merges_sql('r3', N0)}), m3z AS (SELECT list('<' || a || '><' || b || '>|<' || new_id || '>' ORDER BY new_id) AS ms FROM m3), "
        f"{sizes('la', 'FROM m1 UNION ALL FROM m2')}, {sizes('lb', 'FROM m3')}, {tokens('ta', 'mz', 'la')}, {tokens('tb', 'm3z', 'lb')}, "
        "j AS (SELECT ta.lang, count(*) AS shared_ends, count(*) FILTER (ta.n = tb.n) AS same_tokens FROM ta JOIN tb USING (doc_id, line_no, e) GROUP BY ta.lang), "
        "ca AS (SELECT lang, count(*) AS old_tokens FROM ta GROUP BY lang), cb AS (SELECT lang, count(*) AS new_tokens FROM tb GROUP BY lang) "
        "SELECT ca.lang, old_tokens, new_tokens, shared_ends, same_tokens FROM ca JOIN cb ON ca.lang IS NOT DISTINCT FROM cb.lang JOIN j ON ca.lang IS NOT DISTINCT FROM j.lang"
    )


ORACLES["q_alignment"] = alignment_sql(MERGES_1 + 10)
ORACLES["q_langid_trained"] = langid_sql()
ORACLES["q_sample_trim"] = SAMPLE_TRIM
ORACLES["q_vocab_diff"], ORACLES["q_vocab_diff_all"] = vocab_diff_sql(60, "[U+"), vocab_diff_sql(60, "")
