"""The audit log as a stream: sessions of activity and idempotent upserts of check results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from addrloom.operators.sums import ordered


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """A row for each session of a key, streaming or batch; events later than ``late`` are too late."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def append(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """The log with a batch of new events behind it, their ids going on from the last one in the batch's order. The log is only read."""
    last = log.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    numbered = ordered(new, [F.col(c) for c in order])
    return log.unionByName(numbered.withColumn("event_id", (F.col("rank") + F.lit(last)).cast(log.schema["event_id"].dataType)).select(*log.columns))


def append_batch(batch: DataFrame, number: int, path: str, order: list[str]) -> None:
    """Micro-batch ``number`` into the log at ``path``, a folder for each batch, with ids that go on without a gap.

    The first id comes from the sizes of the batches before, a row for each in ``path``/sizes; the log itself isn't read. A batch
    that runs again writes the same folder with the same ids, whether its first run got to its end or not.
    """
    spark = batch.sparkSession
    sizes = f"{path}/sizes"
    before = 0
    if number:
        before = spark.read.schema("batch bigint, n bigint").parquet(sizes).where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = ordered(batch, [F.col(c) for c in order])
    rows.select((F.col("rank") + F.lit(before)).alias("event_id"), *batch.columns).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    n = spark.read.parquet(f"{path}/events/batch={number}").count()
    spark.createDataFrame([(n,)], "n bigint").coalesce(1).write.mode("overwrite").parquet(f"{sizes}/batch={number}")


def append_stream(stream: DataFrame, path: str, order: list[str], checkpoint: str) -> StreamingQuery:
    """What arrives, appended to the log at ``path`` exactly once."""
    return stream.writeStream.foreachBatch(lambda b, k: append_batch(b, k, path, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(events: DataFrame, until: Column) -> DataFrame:
    """The state of each key at a time: its events so far, the last one and when it came; by time, then id."""
    past = events.where(F.col("ts") <= until)
    return past.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("since"))


def watch(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New files of an append-only log."""
    return spark.readStream.schema(schema).parquet(folder)


#: Folders that a table of results is dealt into by run.
PARTS = 256


def upsert_results(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch adds the results not yet stored; running a batch again adds nothing.

    The table lies in PARTS folders by run; a batch reads those of its own runs only.
    """
    keys = ["run_id", "candidate_id", "check_id", "version"]

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys).withColumn("part", F.pmod(F.hash("run_id"), F.lit(PARTS)))
        if spark.catalog.tableExists(table):
            parts = [r.part for r in fresh.select("part").distinct().collect()]  # PARTS at most
            fresh = fresh.join(spark.table(table).where(F.col("part").isin(parts)), [*keys, "part"], "left_anti")
        fresh.write.mode("append").partitionBy("part").saveAsTable(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
