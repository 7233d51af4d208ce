"""Incremental ingest: a stream of record files kept as a table of current rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillstone.operators.select import best_per_key


def upsert_stream(files: str, schema: StructType, target: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Keep ``target`` (parquet, partitioned by a hash bucket of the keys) as the newest row per key of all JSON files so far.

    A batch rewrites only the buckets it touches, by dynamic partition overwrite. A batch that runs again after a failure
    gives the same table, as the newest row stays the newest.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = spark.readStream.schema(schema).json(files)

    def apply(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        every = new
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            touched = new.select("bucket").distinct()
            old = session.read.parquet(target).join(F.broadcast(touched), "bucket", "left_semi")  # at most ``buckets`` rows
            every = new.unionByName(old.select(new.columns))
        newest = best_per_key(every, keys, [F.desc(c) for c in order])
        # The rows are read from the partitions that are overwritten: write them aside first.
        aside = f"{checkpoint}/aside"
        newest.write.mode("overwrite").parquet(aside)
        session.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(target)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
