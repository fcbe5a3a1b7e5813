from pyspark.sql import functions as F

from heronry.llm import zstd_quality as M


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = M.op6_zstd_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert wins >= 0.85 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(0, 1), (6, 0), (7, 0), (8, 1)], "doc_id bigint, quality int")
    got = M.score(odd, M.learn(odd, labels, F.lit(True)))
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    one = M.score(odd, M.learn(odd, labels.where("quality = 1"), F.lit(True)))
    assert {r.score for r in one.collect()} == {1.0}
    assert {r.score for r in M.score(odd, M.learn(none, labels, F.lit(True))).collect()} == {0.5} and M.score(none, M.fit([], [])).count() == 0


def test_dictionaries_learn_from_whole_texts():
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    common, good, bad = ([word() for _ in range(300)] for _ in range(3))
    say = lambda own, n: " ".join(rng.choices(own, k=n))
    labels = [k % 2 for k in range(40)]
    texts = [say(common, 2000) + " " + say(good if y else bad, 2000) for y in labels]  # what tells them apart starts after 16,000 bytes
    model = M.fit(texts, labels)
    assert model.difference(say(good, 2000)) > 0.05 and model.difference(say(bad, 2000)) < -0.05


def test_conflicting_labels_and_a_plain_scorer(spark):
    import numpy as np
    import zstandard

    docs = spark.createDataFrame([(k, f"{'fine words of a calm text' if k % 3 else 'BUY now !!! $$$'} {k} " * 30) for k in range(90)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(90)] + [(k, 0) for k in range(0, 90, 3)], "doc_id bigint, quality int")
    model, again = M.learn(docs, labels, F.lit(True)), M.learn(docs.repartition(5), labels.repartition(7, F.rand(1)), F.lit(True))
    assert (model.good, model.bad) == (again.good, again.bad) and all((a == b).all() for a, b in zip(model.curve, again.curve))

    def size(text, content):
        tool = zstandard.ZstdCompressor(level=M.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        data = text.encode()
        return sum(len(tool.compress(data[k : k + M.PIECE])) for k in range(0, len(data), M.PIECE))

    for r in M.score(docs, model).join(docs, "doc_id").collect():
        x = (size(r.text, model.bad) - size(r.text, model.good)) / len(r.text.encode())
        assert abs(r.score - float(np.interp(x, *model.curve))) < 1e-12
    scores = {r.doc_id: r.score for r in M.score(docs, model).collect()}
    assert min(scores[k] for k in scores if k % 3) > max(scores[k] for k in range(0, 90, 3))
