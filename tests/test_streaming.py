from quillspark.streaming import incremental as I


def test_append_new_is_idempotent(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id long, v string").write.parquet(src)
    schema = "id long, v string"
    for k in range(2):  # a second run from scratch sees the same files again
        I.append_new(I.file_stream(spark, src, schema), "id", out, f"file://{tmp_path}/ck{k}").awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
    spark.createDataFrame([(3, "c"), (2, "x")], schema).write.mode("append").parquet(src)
    I.append_new(I.file_stream(spark, src, schema), "id", out, f"file://{tmp_path}/ck1").awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = f"file://{tmp_path}/ev"
    events.write.parquet(src)
    stream = I.windowed_counts(I.file_stream(spark, src, events.schema), "ts", ["event_type"], "1 day", "3650 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == events.count()


def test_for_each(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(10).write.parquet(src)
    I.for_each(I.file_stream(spark, src, "id long"), lambda b: b.where("id % 2 = 0"), out, f"file://{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(out).count() == 5


def replayed(path):
    """Takes the last commit of a checkpoint back, as if Spark had died between a batch's write and its commit."""
    commits = sorted((p for p in (path / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    return len(commits)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    src, schema = f"file://{tmp_path}/in", "id long, v string"
    runs = {
        "each": lambda: I.for_each(I.file_stream(spark, src, schema, 2), lambda b: b.where("id % 2 = 0"), f"file://{tmp_path}/each", f"file://{tmp_path}/ck-each"),
        "new": lambda: I.append_new(I.file_stream(spark, src, schema, 2), "id", f"file://{tmp_path}/new", f"file://{tmp_path}/ck-new"),
    }
    for name, run in runs.items():
        spark.range(100).selectExpr("id % 40 as id", "cast(id as string) as v").repartition(5).write.mode("overwrite").parquet(src)
        run().awaitTermination()
        rows = lambda: sorted((r.id, r.v) for r in spark.read.schema(schema).parquet(f"file://{tmp_path}/{name}").collect())  # noqa: B023, E731
        once = rows()
        assert len(once) == {"each": 50, "new": 40}[name]
        assert replayed(tmp_path / f"ck-{name}") == 3
        run().awaitTermination()
        assert rows() == once
        spark.createDataFrame([(7, "x"), (1000, "y")], schema).write.mode("append").parquet(src)
        run().awaitTermination()
        assert len(rows()) == len(once) + 1


def test_another_checkpoint_overwrites_nothing(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.range(10).write.parquet(src)
    for k in range(2):
        I.for_each(I.file_stream(spark, src, "id long"), lambda b: b, out, f"file://{tmp_path}/ck{k}").awaitTermination()
    assert spark.read.parquet(out).count() == 20


def test_nulls_are_not_new(spark, tmp_path):
    src, out, schema = f"file://{tmp_path}/in", f"file://{tmp_path}/out", "id long, v string"
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], schema)
    df.write.parquet(src)
    assert I.appended(spark, out, df.schema).count() == 0
    I.append_new(I.file_stream(spark, src, schema), "id", out, f"file://{tmp_path}/ck").awaitTermination()
    assert [tuple(r) for r in I.appended(spark, out, df.schema).collect()] == [(1, "b")]
