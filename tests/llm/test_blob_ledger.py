import hashlib
import re

from heronry.llm import blob_ledger as M

from ..differential import duck, rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans.sort()
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return (*(sum(x[2] == k for x in spans) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest())


TEXTS = ["token=secret:abcdefghij", "Secret: 'aaaaaaaa' x password==bbbbbbbbb", "é\U0001f600 api_key = 12345678", "AKIAAKIA12345678 AKIA12345678901", "deadbeef" * 4 + "g" + "0" * 31, "toKen:short apikey:longenough1", "x" * 50 + "ghp_" + "a" * 40, "\n-----BEGIN RSA PRIVATE KEY-----\n"]


def test_spans(spark, documents):
    docs = [*documents, *((10_000 + k, t) for k, t in enumerate(TEXTS))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in M.report(M.findings(df, M.update(df))).collect()}
    assert got == {i: brute(t) for i, t in docs}


def test_query(spark, sf_dir):
    q = M.op9_blob_ledger(spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", q._jdf.queryExecution().executedPlan().toString())
    assert rows(q) == duck(sf_dir, M.SQL)


def test_only_unseen_pairs_are_scanned(spark):
    a = spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[1]), (3, TEXTS[1])], "doc_id bigint, text string")
    b = spark.createDataFrame([(2, TEXTS[1]), (4, TEXTS[2])], "doc_id bigint, text string")
    first = M.cut(M.update(a))
    assert first.count() == 2
    second = M.cut(M.update(b, first))
    assert [r.blob for r in second.collect()] == [hashlib.sha256(TEXTS[2].encode()).hexdigest()]
    fewer = M.RULES[:1]
    assert M.update(a, first.unionByName(second), fewer).count() == 2  # another rule version
    assert M.findings(b, first.unionByName(second)).where("spans IS NULL").count() == 0


def test_odd_rows(odd, none):
    got = M.report(M.findings(odd, M.update(odd)))
    assert got.count() == odd.count() and M.report(M.findings(none, M.update(none))).count() == 0
    r = got.where("doc_id = 6").first()
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1)


def test_each_blob_is_scanned_once(spark):
    two = "token=aaaaaaaa1 and later password: bbbbbbbb22"
    docs = [(1, TEXTS[0]), (1, TEXTS[0]), (1, two), (None, two + " x"), (None, two + " x"), (2, two), (None, two), (None, TEXTS[2]), (None, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    ledger = M.update(df)
    assert ledger.count() == len({t or "" for _, t in docs})
    got = sorted((r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in M.report(M.findings(df, ledger)).collect())
    assert got == sorted((i or 0, *brute(t)) for i, t in docs)
