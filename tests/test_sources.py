import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import sinks, text
from corpusloom.streaming import lines as streaming


def test_files(spark, tmp_path):
    (tmp_path / "xhosa_train.txt").write_bytes(b"one\ntwo\xff\n\n  \nlast")
    (tmp_path / "other.txt").write_bytes(b"x")
    found = text.read_dir(spark, str(tmp_path), "_train.txt").collect()
    assert [(r.lang, r.text) for r in found] == [("xhosa", "one\ntwo�\n\n  \nlast")]
    assert text.head_bytes(spark, str(tmp_path / "xhosa_train.txt"), 5).first().head == b"one\nt"
    lines = text.read_dir_lines(spark, str(tmp_path), "_train.txt").orderBy("block", "at").collect()
    assert [(r.lang, r.text) for r in lines] == [("xhosa", t) for t in ("one", "two\ufffd", "", "  ", "last")]
    docs = text.read_dir(spark, str(tmp_path), "_train.txt").withColumn("doc_id", F.lit(7).cast("long"))
    pick = lambda keep: [(r.line_no, r.text) for r in text.lines(docs, keep).orderBy("line_no").collect()]
    assert [i for i, _ in pick("all")] == [0, 1, 2, 3, 4]
    assert [i for i, _ in pick("nonempty")] == [0, 1, 3, 4] and [i for i, _ in pick("nonblank")] == [0, 1, 4]


def test_lines_of_split_files(spark, tmp_path):
    """Splits of a few bytes: each line once, and in order."""
    want = [f"line {i} é" for i in range(2000)]
    (tmp_path / "a b.txt").write_text("\n".join(want), encoding="utf-8")
    had = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in had:
            spark.conf.set(k, "900")
        df = text.read_dir_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert [(r.lang, r.text) for r in df.orderBy("block", "at").collect()] == [("a b", t) for t in want]
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)


def test_ranged_fetch_over_http(spark):
    import http.server
    import threading

    body = b"first line\nsecond line\n" * 100_000

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        head = text.head_bytes(spark, f"http://127.0.0.1:{server.server_port}/x.txt", 16).first().head
    finally:
        server.shutdown()
    assert bytes(head) == body[:16]


def test_missing_source_fails(spark, tmp_path):
    (tmp_path / "xhosa.txt").write_text("a")
    one, two = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["Xhosa"], ["Xhosa", "Nigerian Pidgin"]))
    assert text.sourced(one, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError, match="nigerian_pidgin"):
        text.sourced(two, str(tmp_path))


def test_trim_and_size(spark):
    df = spark.createDataFrame([("ab\ncd",), ("ab",), ("\nab",), ("a\n",), ("",)], "t string")
    assert [r[0] for r in df.select(text.trimmed_to_line(df.t)).collect()] == ["ab", "ab", "\nab", "a", ""]
    assert [tuple(r[0]) for r in df.select(text.sample_size(df.t)).collect()][0] == (5, 2)


def test_slugs(spark):
    df = spark.createDataFrame([("Nigerian Pidgin",), ("Luo (Dholuo)",)], "n string")
    assert [tuple(r) for r in df.select(text.slug(df.n), text.coverage_slug(df.n)).collect()] == [("nigerian_pidgin", "nigerian"), ("luo_(dholuo)", "luo")]
    assert [j for j, _ in text.SAMPLE_JOBS][:3] == ["amharic", "hausa", "somali"]
    assert text.sample_jobs(spark).agg(F.sum("n_bytes")).first()[0] == 88_000_000


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y"), ("b", 1, "x")], "lang string, n int, text string")
    sinks.write_corpus(df, str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c/lang=a")).collect()] == ["y", "z"]
    sinks.write_combined(df, str(tmp_path / "d"), "lang", "n")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["x", "y", "z"]
    sinks.atomic_json(str(tmp_path / "m.json"), {"a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}
    made = []
    make = lambda d: (made.append(1), d.where("n = 1"))[1]
    for _ in range(2):
        assert sinks.made_once(make, df, str(tmp_path / "once")).count() == 2
    assert len(made) == 1
    assert sinks.made_once(make, df.where("n = 2"), str(tmp_path / "once")).count() == 0 and len(made) == 2


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("é one\nгде это\n\n")
    query = streaming.cleaned(streaming.stream_lines(spark, str(tmp_path / "in"), "x")).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.text for r in spark.table("kept").collect()] == ["e[U+00E9 LATIN SMALL LETTER E WITH ACUTE] one"]
    (tmp_path / "ev").mkdir()
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 05:10:00', 'a', 2.0D")
    rows.write.parquet(str(tmp_path / "ev/p"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "ev/p"))
    query = streaming.event_counts(live).writeStream.format("memory").queryName("ev").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("ev").count() == 2
