import numpy as np
from pyspark.sql import functions as F

from heronry.operators import cosines, search


def test_best_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    vectors = [base[k % 60].tolist() for k in range(240)]  # each four times: ties by id
    vectors += [None, [], [0.0] * 8, [1.0, 2.0], [None] + [1.0] * 7]
    corpus = spark.createDataFrame([(k, v, f"g{k % 3}") for k, v in enumerate(vectors)], "item_id bigint, vector array<float>, g string").repartition(3)
    asked = [(k, vectors[k], w, r) for k, w, r in ((0, None, []), (1, "g1", [1, 61, 64]), (2, "none", []), (7, "g0", None), (240, None, [3]), (241, None, []), (242, "g2", []), (243, None, [5]), (244, None, []))]
    q = spark.createDataFrame(asked, "query_id int, vector array<float>, wanted string, rejected array<bigint>")
    every = search.vector_scores(q, corpus).join(q.select("query_id", "wanted", "rejected"), "query_id").join(corpus.select("item_id", "g"), "item_id")
    every = every.where("(wanted IS NULL OR wanted = g) AND NOT array_contains(coalesce(rejected, array()), item_id)")
    want = sorted(tuple(r) for r in search.ranked(every, "vector", 7).collect())
    for rows, chunk in ((4096, 256), (11, 2)):
        monkeypatch.setattr(cosines, "ROWS", rows)
        monkeypatch.setattr(cosines, "CHUNK", chunk)
        assert sorted(tuple(r) for r in search.vector(q, corpus, 7).collect()) == want


def test_only_what_can_rank_leaves_a_task(spark):
    corpus = spark.range(5000).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("vector"))
    q = corpus.where("item_id < 20").withColumnRenamed("item_id", "query_id")
    found = search.vector_scores(q, corpus, 5)
    assert found.count() <= 20 * 8 * spark.sparkContext.defaultParallelism * 4
    assert search.vector(q, corpus, 5).where("rank = 1 AND query_id = item_id").count() == 20
