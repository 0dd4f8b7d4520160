"""Secret scans in SQL functions: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

KINDS = ("assign", "access", "hex", "random")


def _either(word: str) -> str:
    """The pattern of a word whose ASCII letters match in either case, and nothing else does."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = "|".join(_either(k) for k in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs that may be random: any of the encodings below, 20 characters or more, with padding.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"

_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings, the narrowest first: name, pattern of a whole token, alphabet, chance that two letters of a text written in it are equal.
ENCODINGS = (
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef", 0.15),
    ("HEX", "[0-9A-F]+", _DIGITS + "ABCDEF", 0.15),
    ("lower", "[a-z]+", _LOW, 0.065),
    ("upper", "[A-Z]+", _UP, 0.065),
    ("base32", "[A-Z2-7]+", _UP + "234567", 0.065),
    ("lower36", "[a-z0-9]+", _LOW + _DIGITS, 0.065),
    ("upper36", "[A-Z0-9]+", _UP + _DIGITS, 0.065),
    ("letters", "[A-Za-z]+", _UP + _LOW, 0.065),
    ("base62", "[A-Za-z0-9]+", _UP + _LOW + _DIGITS, 0.065),
    ("base64", "[A-Za-z0-9+/]+", _UP + _LOW + _DIGITS + "+/", 0.065),
    ("base64url", "[A-Za-z0-9_-]+", _UP + _LOW + _DIGITS + "-_", 0.065),
    ("mixed", ".+", _UP + _LOW + _DIGITS + "+/-_", 0.065),
)
_ALL = _UP + _LOW + _DIGITS + "+/-_"
_CLASSES = "U" * 26 + "L" * 26 + "D" * 10 + "SSSS"


def _found(kind: int, pattern: str, group: int) -> Column:
    """All matches of a pattern in order, each with the length of the text between it and the one before; group is the part that is kept."""
    text = F.col("text")
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    rows = F.transform(
        F.arrays_zip(gaps.alias("g"), whole.alias("w"), part.alias("p")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x.g).cast("long").alias("gap"), F.length(x.w).cast("long").alias("len"), F.length(x.p).alias("size"), (x.p if kind == 3 else F.lit("")).alias("token")
        ),
    )
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,size:int,token:string>>"))


def lower_tail(z: Column) -> Column:
    """P(Z <= z) of a standard normal Z; in the far tail the upper bound phi(z) / |z|, so that it is never too small there."""
    body = 1 / (1 + F.exp(-1.5976 * z - 0.070565992 * z * z * z))
    return F.when(z < -3, F.exp(-z * z / 2) / (2.5066282746310002 * F.greatest(F.abs(z), F.lit(1.0)))).otherwise(body)


def tests(tokens: DataFrame) -> DataFrame:
    """Adds to rows with a token: encoding, n (symbols without padding), the tests' z values and ``p``.

    ``uniform`` is whether the token passes as random: neither the chi-squared statistic of its alphabet's counts (too
    uneven), nor the number of runs of a character class, nor the serial correlation of neighbouring symbols (either
    way) departs from uniform draws at 1/1000 together (Bonferroni). ``p`` is the chance that text written in the
    encoding looks as even and as mixed: chi-squared and runs against what text has, joined by Stouffer's rule; this is
    what false discoveries are counted by.
    """
    which = F.coalesce(*[F.when(F.col("s").rlike(f"^{p}$"), F.lit(k)) for k, (_, p, _, _) in enumerate(ENCODINGS)])
    pick = lambda of: F.element_at(F.array(*[F.lit(of(e)) for e in ENCODINGS]), F.col("k") + 1)
    t = tokens.withColumn("s", F.regexp_replace("token", "=+$", "")).withColumn("k", which)
    t = t.withColumn("n", F.greatest(F.length("s"), F.lit(2)).cast("double")).withColumn("alphabet", pick(lambda e: e[2])).withColumn("same", pick(lambda e: e[3]))
    t = t.withColumn("size", F.length("alphabet").cast("double")).withColumn("classes", F.translate("s", _ALL, _CLASSES))
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda a, c: a + F.pow((F.col("n") - F.length(F.replace("s", c, F.lit("")))), F.lit(2.0)))
    t = t.withColumn("chi", F.col("size") / F.col("n") * squares - F.col("n"))
    t = t.withColumn("runs", 1.0 + F.regexp_count("classes", F.lit("L(?=[^L])|U(?=[^U])|D(?=[^D])|S(?=[^S])")))
    # how often neighbours of a uniform token differ in class
    share = {e[0]: 1 - sum((sum(c in part for c in e[2]) / len(e[2])) ** 2 for part in (_LOW, _UP, _DIGITS, "+/-_")) for e in ENCODINGS}
    t = t.withColumn("turn", pick(lambda e: float(share[e[0]])))
    places = F.transform(F.filter(F.split("s", ""), lambda c: c != ""), lambda c: F.instr(F.col("alphabet"), c).cast("double") - (F.col("size") + 1) / 2)
    t = t.withColumn("x", places)
    product = F.aggregate(F.zip_with(F.slice("x", F.lit(1), F.greatest(F.size("x") - 1, F.lit(0))), F.slice("x", F.lit(2), F.greatest(F.size("x") - 1, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    n, size, turn = F.col("n"), F.col("size"), F.col("turn")
    t = t.withColumn("serial", product / ((n - 1) * (size * size - 1) / 12) * F.sqrt(n - 1)).drop("x")
    t = t.withColumn("z_chi", (F.col("chi") - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n))
    t = t.withColumn("z_runs", F.when(turn > 0, (F.col("runs") - 1 - (n - 1) * turn) / F.sqrt((n - 1) * turn * (1 - turn) + 1e-9)).otherwise(0.0))
    worst = F.least(lower_tail(-F.col("z_chi")), 2 * lower_tail(-F.abs("z_runs")), 2 * lower_tail(-F.abs("serial")))
    uneven = (n - 1) * (size * F.col("same") - 1)
    text_chi = (F.col("chi") - (size - 1) - uneven) / F.sqrt(2 * (size - 1) + 4 * uneven + F.pow(0.2 * uneven, F.lit(2.0)))
    # joined words in mixed case turn from one class to another about once in four letters
    text_runs = F.when(turn > 0, ((n - 1) * 0.25 - (F.col("runs") - 1)) / F.sqrt((n - 1) * 0.19))
    joint = F.when(turn > 0, (text_chi + text_runs) / F.sqrt(F.lit(2.0))).otherwise(text_chi)
    return t.withColumn("uniform", 3 * worst >= 0.001).withColumn("p", F.greatest(lower_tail(joint), F.lit(1e-300))).withColumn("encoding", pick(lambda e: e[0]))


#: p values are rounded up to a tenth of a power of ten, so that a length class has a few thousand different ones at most.
STEP = 10


def discovered(tested: DataFrame, rate: float) -> DataFrame:
    """The tokens that Benjamini and Hochberg's rule at ``rate`` calls random, by classes of length (doublings), so that the many short tokens do not decide over the long ones.

    Every candidate of the corpus counts in its class. What is broadcast is one row for each of four classes.
    """
    t = tested.withColumn("length_class", F.least(F.floor(F.log2("n")), F.lit(7)).cast("int")).withColumn("bin", F.floor(-F.log10("p") * STEP).cast("int"))
    hist = t.groupBy("length_class", "bin").count()
    upto = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    ranked = hist.withColumn("rank", F.sum("count").over(upto)).withColumn("all", F.sum("count").over(Window.partitionBy("length_class")))
    limits = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / STEP) * F.col("all") <= rate * F.col("rank")).groupBy("length_class").agg(F.min("bin").alias("least"))
    return t.join(F.broadcast(limits), "length_class").where(F.col("uniform") & (F.col("bin") >= F.col("least")))


def secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """(row, doc_id, text_hash, spans) for each row of doc_id, text; spans is an array of (start, kind, end) in code points, by start and then kind.

    kind is the place in KINDS. The first three are the fixed patterns, leftmost and non-overlapping by kind; "random"
    are runs of 20 or more letters, digits and +/_- (not digits alone) that the test battery calls random and that lie
    in no span of the other kinds. row numbers the rows as read, so rows that repeat stay apart; text_hash is the XXH64
    of the text, to find it again. A null text is empty and has no spans; a null doc_id stays null; an empty table gives
    no rows; other columns are not read. The text is read once, and what is dealt afterwards are the matches alone.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = F.concat(_found(0, ASSIGN, 2), _found(1, ACCESS, 0), _found(2, HEX, 0), _found(3, CANDIDATE, 0))
    read = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), found.alias("found")))
    before = Window.partitionBy("row", "kind").orderBy("i")
    placed = (
        read.select("row", F.inline("found"))
        .withColumn("start", F.sum(F.col("gap") + F.col("len")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len"))
        .withColumn("end", F.col("start") + F.col("len"))
    )
    placed = cut(placed.where((F.col("kind") != 0) | (F.col("size") >= 8)).select("row", "kind", "start", "end", "token"))
    candidates = placed.where((F.col("kind") == 3) & ~F.col("token").rlike("^[0-9=]+$"))
    # kept: conditions on what the tests give would be put in terms of the token again, in plans that take the driver's time and memory
    tested = cut(tests(candidates).select("row", "kind", "start", "end", "n", "p", "uniform"))
    random = discovered(tested, rate).select("row", "kind", "start", "end")
    spans = placed.where("kind < 3").select("row", "kind", "start", "end").unionByName(random)
    upto = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("covered", F.max(F.when(F.col("kind") < 3, F.col("end"))).over(upto)).where("kind < 3 OR covered IS NULL OR covered < end")
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return read.select("row", "doc_id", "text_hash").join(by_row, "row", "left").withColumn("spans", F.coalesce("spans", empty))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans replaced by a mark."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = F.when(s.start > acc.at, F.array(F.substring(text, acc.at.cast("int") + 1, (s.start - acc.at).cast("int")), F.lit(mark)))
        first = F.when((s.start == 0) & (acc.at == 0), F.array(F.lit(mark)))
        return F.struct(F.greatest(acc.at, s.end).alias("at"), F.concat(acc.out, F.coalesce(fresh, first, F.array().cast("array<string>"))).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.at.cast("int") + 1, F.length(text))))


def merged(found: DataFrame, *keys: str) -> DataFrame:
    """keys and ``runs``: the spans of each row of found, which has keys once, as (start, end) of what overlapping or touching ones cover, in order. Rows without spans are left out."""
    each = found.select(F.struct(*keys).alias("k"), F.inline("spans"))
    before = Window.partitionBy("k").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = each.select("k", "kind", "start", "end", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int").alias("fresh"))
    upto = Window.partitionBy("k").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = fresh.withColumn("run", F.sum("fresh").over(upto)).groupBy("k", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs")).select("k.*", "runs")


def redact_runs(text: Column, runs: Column, mark: str = "[SECRET]") -> Column:
    """The text with each of its runs, which lie apart and in order, replaced by a mark, in time in proportion to the text: it is cut into characters once."""

    def marked(chars: Column) -> Column:
        part = lambda a, z: F.array_join(F.slice(chars, a.cast("int") + 1, (z - a).cast("int")), "")
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
        starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(chars).cast("long")))
        return F.array_join(F.zip_with(ends, starts, part), mark)

    return F.get(F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), marked), F.lit(0))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start, s.end)), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s.kind == k)).cast("long")
    return secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.filter(spans, lambda s: s.kind < 3)), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
    )
