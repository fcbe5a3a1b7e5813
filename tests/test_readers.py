import json

from pyspark.sql import functions as F

from heronry.sources import readers


def streamed(reader, spark, path, where, name, per_trigger=1):
    """All rows of a reader as a stream that is run, stopped, and run again from its checkpoint."""
    for _ in range(2):
        q = reader(spark, path, stream=True, per_trigger=per_trigger).writeStream.format("parquet").option("checkpointLocation", f"{where}/{name}-ck").option("path", f"{where}/{name}-out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{where}/{name}-out")


def same(a, b):
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    return key(a) == key(b)


def plain(tokens):
    """The records of a diff, read token by token."""
    t, out, i = [x for x in tokens if x], [], 0
    while i < len(t):
        s = t[i]
        need = 3 if s[0] in "RC" else 2
        if i + need > len(t):
            return [*out, (" ".join(t[i:]), None, None, None, True)]
        if s[0] == "R":
            out.append((t[i + 2], "renamed", t[i + 1], (int(s[1:]) if s[1:].isdigit() else 0) or 100, False))
        else:
            out.append((t[i + need - 1], {"A": "added", "C": "added", "D": "deleted"}.get(s[0], "modified"), None, None, False))
        i += need
    return out


def test_diffs(spark, tmp_path):
    cases = [
        ["M", "a b.ts", "R087", "old.ts", "new.ts", "A", "x", "D", "y", "C75", "from", "to", "T", "z"], ["R", "p", "q"], [], ["R000", "p", "q", "M", "é\n.ts"], ["M", "a", "R100", "only one"], ["A"], ["X1", "odd", "", "M", "after an empty one"],
    ]
    d = tmp_path / "diffs"
    d.mkdir()
    for k, tokens in enumerate(cases):
        (d / f"{k}.z").write_text("\0".join(tokens) + ("\0" if tokens else ""))
    batch = readers.diffs(spark, f"file://{d}")
    got = {k: [] for k in range(len(cases))}
    for r in batch.collect():
        got[int(r.file.rpartition("/")[2][0])].append(tuple(r)[1:])
    assert got == {k: plain(t) for k, t in enumerate(cases)}
    assert same(batch, streamed(readers.diffs, spark, f"file://{d}", tmp_path, "diffs"))


def test_inventory(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"src/a.md": "x", "src/deep/er/b.ts": "yy", "node_modules/m/c.js": "z", "d.PNG": "p", "big.txt": "w" * (readers.MOST + 1), "my.git/e": "ok"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    batch = readers.inventory(spark, f"file://{root}")
    assert {r.path: (r.skip, r["hash"] is None, r["size"]) for r in batch.collect()} == {
        "src/a.md": (None, False, 1), "src/deep/er/b.ts": (None, False, 2), "node_modules/m/c.js": ("excluded", True, 1), "d.PNG": ("binary", True, 1), "big.txt": ("too_large", True, readers.MOST + 1), "my.git/e": (None, False, 2),
    }
    assert same(batch, streamed(readers.inventory, spark, f"file://{root}", tmp_path, "tree"))


def test_commits_and_incidents(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "1").write_text("----abcdef1\na.ts\nb.ts\na.ts\n----abcdef2\n\na.ts\n----not a commit\nx.ts\n")
    (log / "2").write_text("----0123456789\nsrc/c.ts\n")
    batch = readers.commits(spark, f"file://{log}")
    assert sorted(tuple(r) for r in batch.collect()) == [("0123456789", "src/c.ts"), ("abcdef1", "a.ts"), ("abcdef1", "b.ts"), ("abcdef2", "a.ts")]
    assert same(batch, streamed(readers.commits, spark, f"file://{log}", tmp_path, "log"))
    err = tmp_path / "err"
    (err / "2024").mkdir(parents=True)
    for k in range(6):
        (err / f"2024/{k}.json").write_text(json.dumps({"id": f"e{k}", "category": "net", "severity": k, "message": "down\nagain", "occurrences": 2, "ts": "2024-01-01T00:00:00Z"}, indent=2))
    (err / "bad.json").write_text('{"id": "e9", ')
    (err / "no-id.json").write_text('{"category": "net"}')
    batch = readers.incidents(spark, f"file://{err}")
    assert batch.groupBy("malformed").count().orderBy("malformed").collect() == [(False, 6), (True, 2)]
    assert batch.where("NOT malformed").agg(F.sum("severity")).first()[0] == 15
    assert same(batch, streamed(readers.incidents, spark, f"file://{err}", tmp_path, "err"))
