from pyspark.sql import functions as F

from heronry.operators import state as S


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert sorted(tuple(r) for r in S.upsert(old, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_valid(spark):
    e = spark.createDataFrame([(1, None), (2, "not a time"), (3, "2024-02-01"), (4, "2024-01-01")], "src int, valid_until string")
    assert sorted(r.src for r in S.valid(e, "2024-01-31").collect()) == [1, 2, 3]


def test_path_policy(spark):
    paths = {"a/node_modules/x.js": "excluded", "a/b.JPG": "binary", "a/b.md": None}
    got = {r.p: r.x for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.path_policy(F.col("p"), F.lit(1)).alias("x")).collect()}
    assert got == paths


def test_rerank(spark):
    fused = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4)], "query_id int, item_id int, score double")
    q = spark.createDataFrame([(1, ["alpha", "beta"])], "query_id int, terms array<string>")
    texts = spark.createDataFrame([(11, "alpha beta gamma", 80)], "item_id int, content string, trust int")
    got = [(r.item_id, r.overlap, r.final) for r in S.rerank(fused, q, texts).orderBy("rank").collect()]
    assert got == [(11, 1.0, round(0.62 * 0.4 + 0.28 + 0.08, 6)), (10, 0.0, 0.31)]


def test_proposals(spark):
    f = spark.createDataFrame([(1, "stale"), (1, "stale"), (1, "rejected"), (2, "selected")], "item_id int, feedback_type string")
    p = S.proposals(f)
    assert sorted(tuple(r) for r in p.collect()) == [(1, "mark_stale", 2), (1, "review", 1)]
    items = spark.createDataFrame([(1, "approved"), (2, "approved")], "item_id int, status string")
    assert {r.item_id: r.status for r in S.applied(items, p).collect()} == {1: "archived", 2: "approved"}
