"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from nibblespark.operators import storage, workloads
from nibblespark.streaming import arrays as stream


def test_online_edits_with_state(spark, tmp_path):
    rows = [(s, s * 3 % 5, (s * 3 % 5) + 1) for s in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "step long, pos long, v0 long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("step long, pos long, v0 long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = stream.online_edits(source, 8).writeStream.outputMode("append").format("memory").queryName("edits").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(tuple, spark.table("edits").select("pos", "before", "after").collect()))
    a = spark.createDataFrame([(p, p + 1) for p in range(5)], "pos long, v long")
    want = workloads.online_edits(a, spark.createDataFrame(rows, "step long, pos long, v0 long").select("step", "pos"), 8)
    assert got == sorted(map(tuple, want.select("pos", "before", "after").collect()))


def test_chunks_are_encoded_as_they_come(spark, tmp_path):
    for k in range(2):
        spark.range(k * 128, k * 128 + 128).select(F.col("id").alias("pos"), (F.col("id") % 5).cast("int").alias("v")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("pos long, v int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = stream.encode_chunks(source, f"{tmp_path}/out", f"{tmp_path}/ck", 64).trigger(availableNow=True).start()
    run.awaitTermination()
    got = storage.decoded(spark.read.parquet(f"{tmp_path}/out").drop("epoch"))
    assert [r["vals"] for r in got.orderBy("chunk_id").collect()] == [[i % 5 for i in range(k, k + 64)] for k in range(0, 256, 64)]


def test_appended_observations_are_sampled(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, f"o{i}") for i in range(k * 5, k * 5 + 5)], "obs_id long, label string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("obs_id long, label string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    stream.append_observations(source, f"{tmp_path}/buffer", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    ids = spark.createDataFrame([(0, 14), (1, 2), (2, 2)], "k long, i long")
    got = stream.sample_appended(spark, f"{tmp_path}/buffer", ids).orderBy("k").collect()
    assert [r["label"] for r in got] == ["o14", "o2", "o2"]


def test_caches_over_a_stream(spark, tmp_path):
    rows = [(s % 3, s, s * 7 % 23 * 8) for s in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], "cache long, step long, pos long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("cache long, step long, pos long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = stream.lru_reads(source, 16, 3).writeStream.outputMode("append").format("memory").queryName("caches").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("caches").groupBy("cache").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n")).collect()
    for r in got:
        mine = spark.createDataFrame([x[1:] for x in rows if x[0] == r["cache"]], "step long, pos long")
        want = storage.simulated_cache(mine, 16, 3).first()
        assert (want["hits"], want["misses"]) == (r["hits"], r["n"] - r["hits"])
