import corpus_pipeline as P
from heronry.llm import ecoc_langid, es_mixing, prefix_bpe
from heronry.llm.common import cut

from .test_simhash_cover import brute, components


def told_languages(spark, sf_dir, source):
    """doc_id -> language of the documents that the model does not reject, by one text at a time."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = ecoc_langid.learn(docs, F.coalesce(ecoc_langid.fold_crc("doc_id", 4) != 2, F.lit(False)))
    found = {r.doc_id: model.predict(r.text) for r in source}
    return {i: lang for i, (lang, _, ambiguous) in found.items() if lang != "und" and not ambiguous}


def test_the_language_stage_is_the_models(spark, sf_dir):
    """Texts of two languages at once go, though they have letters; a null lang is filled in; named languages bind."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {lang: " ".join(r.text for r in docs.where(f"lang = '{lang}' AND length(text) > 400").orderBy("doc_id").limit(3).collect()).split() for lang in ("en", "fr", "es") if docs.where(f"lang = '{lang}' AND length(text) > 400").limit(1).count()}
    a, b = sorted(words)[:2]
    mixed = [(10**6 + k, " ".join(words[a][8 * k : 8 * k + 4 + k % 3] + words[b][8 * k : 8 * k + 4 + k // 3 % 3]), None) for k in range(40)]
    pure = [(2 * 10**6 + k, " ".join(words[x][30 * k : 30 * k + 30]), None) for k, x in enumerate((a, b, a, b))]
    some = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(mixed + pure, "doc_id bigint, text string, lang string"))
    kept = {r.doc_id: r.lang for r in ecoc_langid.identified(some).collect()}
    assert sum(i in kept for i, _, _ in mixed) < len(mixed), "no text of two languages is rejected"
    assert {i: kept.get(i) for i, _, _ in pure} == dict(zip([i for i, _, _ in pure], (a, b, a, b), strict=True))
    only = ecoc_langid.identified(some, languages=(a,)).where(f"doc_id >= {2 * 10**6}")
    assert {r.doc_id for r in only.collect()} == {2 * 10**6, 2 * 10**6 + 2}


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, kept = docs.columns, {}
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        kept[name] = docs.collect()
        assert name == "tokens" or docs.columns == names
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    told = told_languages(spark, sf_dir, source)
    assert {r.doc_id: r.lang for r in kept["language"]} == {r.doc_id: r.lang if r.lang is not None else told[r.doc_id] for r in source if r.doc_id in told}
    best = {}
    for r in kept["language"]:
        k = r.text.encode().lower()
        best[k] = max(best.get(k, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact"]) == sorted(best.values())
    root = components({r.doc_id: brute(r.text) for r in kept["exact"]})
    assert sorted(r.doc_id for r in kept["near"]) == sorted(set(root.values()))
    ids = {r.doc_id: r for r in kept["tokens"]}
    copies = {}
    for r in kept["mixture"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= es_mixing.MOST and set(ids) == set(copies)
    own = prefix_bpe.encoder(prefix_bpe.public_tokenizers.path(prefix_bpe.VOCABULARY), prefix_bpe.public_tokenizers.PATTERN)
    assert all(own.bpe.decode(ids[r.doc_id].ids) == r.text.encode() for r in kept["mixture"])


def test_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for name, stage in P.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "tokens" or out.columns == docs.columns
            assert docs is odd or out.count() == 0
            out.collect()
    assert ecoc_langid.identified(odd).where("doc_id IN (2, 3, 4)").count() == 0


def test_columns_with_the_names_of_helpers(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = ("score", "ambiguous", "own", "OWN_", "key", "sha", "tie", "copies", "k", "_text", "_own", "_id", "_copies", "Kept", "n_tokens", "text_")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in clash])
    for name, stage in P.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        assert all(r[n] == f"{n}:{r.doc_id}" for r in docs.collect() for n in clash), name
    assert P.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count() > 0
