from pyspark.sql import functions as F

from heronry.sources import packs
from heronry.streaming import incidents


def test_backup_round_trip(spark, sf_dir, tmp_path):
    t = {"nation": spark.read.parquet(f"{sf_dir}/nation.parquet"), "labels": spark.read.parquet(f"{sf_dir}/labels.parquet")}
    schemas = {n: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) for n, df in t.items()}
    path = f"file://{tmp_path}/b1"
    packs.backup(t, path)
    assert all(r.ok for r in packs.verify(spark, path, schemas).collect())
    spark.createDataFrame([(99, 1, 1)], schemas["labels"]).write.mode("append").json(f"{path}/labels")
    assert {r.name: r.ok for r in packs.verify(spark, path, schemas).collect()} == {"labels": False, "nation": True}


def test_front_matter(spark):
    rows = [(1, 'a "quoted"\nclaim', "body\n---\nwith dashes"), (2, None, None)]
    df = spark.createDataFrame(rows, "k bigint, c string, t string")
    back = df.select(packs.to_front_matter(("k", "c"), "t").alias("m")).select(*packs.from_front_matter(F.col("m"), {"k": "bigint", "c": "string"}))
    assert sorted(tuple(r) for r in back.collect()) == [(1, 'a "quoted"\nclaim', "body\n---\nwith dashes"), (2, None, "")]
    bad = spark.createDataFrame([("no front matter",)], "m string").select(*packs.from_front_matter(F.col("m"), {"k": "bigint"})).first()
    assert (bad.k, bad.body) == (None, None)


def test_edges_and_log(spark):
    e = spark.createDataFrame([(2, 1, "refines", 0.5), (1, 2, "refines", 0.7)], "src bigint, dst bigint, kind string, confidence double")
    lines = packs.edge_lines(e)
    assert [r.value for r in lines.collect()][0] == '{"confidence":0.7,"dst":2,"kind":"refines","src":1}'
    assert packs.parse_edges(lines.unionByName(spark.createDataFrame([("{broken",)], "value string"))).count() == 2
    log = spark.createDataFrame([("----abcdef1\na.ts\nb.ts\n----abcdef2\n\na.ts\n",)], "value string")
    assert sorted(tuple(r) for r in packs.commits(log).collect()) == [("abcdef1", "a.ts"), ("abcdef1", "b.ts"), ("abcdef2", "a.ts")]


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.md").write_text("x")
    (tmp_path / "b.png").write_bytes(b"y")
    got = {r.path.rpartition("/")[2]: (r.skip, r.hash is None) for r in packs.files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.md": (None, False), "b.png": ("binary", True)}


def test_incidents_as_a_stream(spark, tmp_path):
    path = f"{tmp_path}/in"
    rows = [(k, f"Failure 0x{k:x} code {'ab'[k % 2]}", k % 5, 1 + k % 3, f"2024-01-01 00:{k:02d}:00") for k in range(20)]
    df = spark.createDataFrame(rows, "event_id bigint, message string, severity int, occurrences bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.where("event_id < 10").write.mode("append").parquet(path)
    df.where("event_id >= 10").write.mode("append").parquet(path)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = incidents.merged(s).writeStream.outputMode("complete").format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    want = sorted(tuple(r) for r in incidents.merged(df).collect())
    assert sorted(tuple(r) for r in spark.table("merged").collect()) == want and len(want) == 2
