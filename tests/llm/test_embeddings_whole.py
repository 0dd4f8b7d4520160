import numpy as np

from corpusloom.llm import embeddings as E

from .test_embeddings import brute, clustered, frame, rows


def test_short_recall_ends_in_comparison(spark, monkeypatch):
    vectors = clustered()
    none = spark.createDataFrame([], "id long, other long, n long")
    monkeypatch.setattr(E, "_search_all", lambda *a: none)
    monkeypatch.setattr(E, "BLOCK_ROWS", 150)
    assert rows(E.linked(frame(spark, vectors), overlap=24)) == sorted(brute(vectors))


def test_audit_is_not_drawn_from_what_was_found(spark):
    """Only pairs of two: where all are missed, the measured recall is 0 and not 1."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate([*x, *(x + 0.02 * rng.normal(size=x.shape)), *rng.normal(size=(400, 16))])]
    nodes = E._sizes(frame(spark, vectors).select("vec_id", "embedding").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS vec"))
    none = spark.createDataFrame([], "id long, n long")
    assert E._recall(nodes, none, len(vectors), 0.95, 16) == 0.0
    some = spark.createDataFrame([(i, 1) for i in range(20)] + [(40 + i, 1) for i in range(20)], "id long, n long")
    assert 0.3 < E._recall(nodes, some, len(vectors), 0.95, 16) < 0.7
