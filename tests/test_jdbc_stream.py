"""SRC1 over JDBC (in-memory Derby inside the JVM, no network port), vectors/stage writers
(SNK3, SNK4, SRC6), and the windowed streaming aggregate over an append-only log (STR2)."""

import os
import tempfile

from pyspark.sql import functions as F

from pawgrid.sources import readers as RD
from pawgrid.sources import sinks as SK
from pawgrid.streaming.incremental import stream_files, windowed_counts

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_jdbc_partitioned_read_and_open_filter(spark):
    url = "jdbc:derby:memory:pawgrid_t;create=true"
    props = {"driver": DERBY}
    rows = [(i, "임보가능" if i % 3 else "임보완료", f"n{i}") for i in range(1, 101)]
    df = spark.createDataFrame(rows, "uid int, state string, name string")
    (df.write.option("createTableColumnTypes", "state VARCHAR(32), name VARCHAR(64)")
     .jdbc(url, "homeprotection", mode="overwrite", properties=props))
    back = RD.read_jdbc(spark, url, "homeprotection", props, partition_column="uid", lower=1, upper=100,
                        num_partitions=4)
    assert back.rdd.getNumPartitions() == 4 and back.count() == 100
    opened = RD.open_listings(back)
    assert opened.count() == 67
    pushed = RD.read_jdbc(spark, url, "homeprotection", props, predicate="\"state\" = '임보가능'")
    assert pushed.count() == 67


def test_vectors_and_processed_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="pawgrid-v-")
    v = spark.createDataFrame([(1, [0.5, 0.5], False)], "uid long, embedding array<float>, failed boolean")
    SK.save_vectors(v, f"{d}/vec", "hash-64", 2)
    back = RD.read_table(spark, f"{d}/vec")
    r = back.first()
    assert r.model == "hash-64" and r.dim == 2 and list(r.embedding) == [0.5, 0.5]
    meta = SK.save_processed(spark.range(5).withColumn("t", F.lit("x")), f"{d}/proc").first()
    assert meta.total_records == 5 and meta.columns == "id,t"


def test_windowed_counts_stream(spark):
    d = tempfile.mkdtemp(prefix="pawgrid-w-")
    src = f"{d}/in"
    data = [("2024-01-01 01:00:00", "view", 1.0), ("2024-01-01 02:00:00", "view", 2.0),
            ("2024-01-02 01:00:00", "click", 3.0)]
    spark.createDataFrame(data, "ts string, event_type string, value double") \
        .withColumn("ts", F.to_timestamp("ts")).write.parquet(src)
    schema = "ts timestamp, event_type string, value double"
    agg = windowed_counts(stream_files(spark, src, schema), "ts", "event_type")
    name = "wc_" + os.path.basename(d).replace("-", "_")
    q = (agg.writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", f"{d}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.event_type, r.n, r.value_sum) for r in spark.table(name).collect()}
    assert got == {("view", 2, 3.0), ("click", 1, 3.0)}
