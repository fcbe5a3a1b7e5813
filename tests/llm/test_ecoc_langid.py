from itertools import combinations

from heronry.llm import ecoc_langid as M


def test_codewords_differ():
    for n in (2, 3, 4, 5, 9, 30):
        code = M.codewords(n)
        assert all((code[a] != code[b]).any() for a, b in combinations(range(n), 2))
        assert all(abs(code[:, k].sum()) < n for k in range(code.shape[1]))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = M.op3_ecoc_langid(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(odd, none):
    model = M.learn(odd, M.F.lit(True))
    got = M.identify(odd, model)
    assert got.count() == odd.count()
    assert {r.lang_pred for r in got.where("doc_id IN (2, 3, 4)").collect()} == {"und"}
    assert got.where("doc_id = 5").select("lang_pred").distinct().collect()[0][0] == "fr"
    assert M.identified(odd).columns == odd.columns
    nothing = M.learn(none, M.F.lit(True))
    assert {r.lang_pred for r in M.identify(odd, nothing).collect()} == {"und"} and M.identified(none).count() == 0


def test_against_a_plain_decoder_and_ambiguity(spark):
    import math

    words = {"aa": "kato miro selu vana", "bb": "xith qorn zwup jexy", "cc": "dhal bhim ghor khen"}
    model = M.fit([f"{w} " * (k + 1) for w in words.values() for k in range(8)], [x for x in words for _ in range(8)])

    def plain(text):
        data = [c if c > 127 or chr(c).isalpha() else 32 for c in text.lower().encode()]
        total, n = [0.0] * model.code.shape[1], sum(c != 32 for c in data)
        for size in M.GRAMS:
            for at in range(len(data) - size + 1):
                h = size
                for c in data[at : at + size]:
                    h = (h ^ c) * 2654435761 % (1 << 32)
                    h ^= h >> 15
                total = [a + float(w) for a, w in zip(total, model.weights[h % M.BUCKETS])]
        z = [a / max(1, n) * s * math.sqrt(min(n, M.TRUSTED)) for a, s in zip(total, model.slope)]
        loss = [sum(t * math.log1p(math.exp(-c * x)) for t, c, x in zip(model.trust, word, z)) for word in model.code]
        p = [math.exp(min(loss) - x) for x in loss]
        return model.languages[loss.index(min(loss))], 1 / sum(p)

    mixed = "kato xith miro qorn selu zwup vana jexy"
    texts = [*words.values(), mixed, "kato", "dhal vana", "qq"]
    got = [r for r in M.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    for r, t in zip(got, texts):
        lang, score = plain(t)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3
    assert [r.lang_pred for r in got[:3]] == list(words) and not any(r.ambiguous for r in got[:3])
    assert got[3].ambiguous


def test_columns_with_the_names_of_results(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog are in the house" if k % 2 else "le chat et le chien sont dans la maison", "en" if k % 2 else "fr", -7.0, "x", k) for k in range(20)], "doc_id bigint, text string, lang string, score double, lang_pred string, text_ bigint")
    kept = M.identified(docs)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
