"""New files and records as a stream, into a store that a batch reads and writes only where its keys lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: Buckets of a new store, how many times as many it gets when it grows, and rows of a bucket from which it grows.
BUCKETS, GROWTH, BUCKET_ROWS = 16, 4, 100_000


def new_records(spark: SparkSession, folder: str, schema: StructType | str, file_format: str = "parquet") -> DataFrame:
    """Records of files that arrive in folder."""
    return spark.readStream.schema(schema).format(file_format).load(folder)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _generations(spark: SparkSession, target: str) -> list[int]:
    """Numbers of buckets for which the store has a whole generation, the one in use last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = [x.getPath() for x in system.listStatus(path) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
    return sorted(int(x.getName().split("=")[1]) for x in done if x.getName().startswith("n="))


def held(spark: SparkSession, target: str, schema: StructType | str) -> DataFrame:
    """The store's rows, with _bucket; a condition on it is a condition on folders."""
    own = _generations(spark, target)
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    if not own:
        return spark.createDataFrame([], fields).withColumn("_bucket", F.lit(0))
    return spark.read.schema(StructType([*fields]).add("_bucket", "integer")).parquet(f"{target}/n={own[-1]}")


def append_new(batch: DataFrame, target: str, key: str, *, bucket_rows: int = BUCKET_ROWS) -> None:
    """Adds the rows of batch whose key the store does not hold, each key once (K3, J3); a batch that runs again adds nothing twice.

    The store is dealt to buckets by a hash of the key. A batch reads the keys of the buckets that its own keys fall in, and adds files to these alone; the
    store gets more buckets as it grows, so a bucket keeps its size and a batch's work follows its own keys.
    """
    spark = batch.sparkSession
    own = _generations(spark, target)
    n = own[-1] if own else BUCKETS
    keyed = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_bucket", bucket_of(key, n))
    if own:
        touched = [r["_bucket"] for r in keyed.select("_bucket").distinct().toLocalIterator()]
        there = held(spark, target, batch.schema).where(F.col("_bucket").isin(touched)).select(key)
        keyed = keyed.join(there, key, "left_anti")
    keyed.repartition("_bucket").write.mode("append").partitionBy("_bucket").parquet(f"{target}/n={n}")
    rows = held(spark, target, batch.schema).count()  # from the files' footers
    while rows > bucket_rows * n:
        n *= GROWTH
    if n > (own[-1] if own else BUCKETS):
        grow(spark, target, batch.schema, key, n)


def grow(spark: SparkSession, target: str, schema: StructType, key: str, n: int) -> None:
    """The store in n buckets: a new generation, in use once it is whole; older ones go."""
    own = _generations(spark, target)
    rows = held(spark, target, schema).withColumn("_bucket", bucket_of(key, n))
    rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/n={n}")
    for old in own:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/n={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(records: DataFrame, target: str, state: str, key: str, *, bucket_rows: int = BUCKET_ROWS) -> StreamingQuery:
    """Appends the stream's records whose key the target does not hold yet, each key once, and stops (K3, J3). The stream keeps no keys: each batch meets the store's in append_new."""
    append = lambda batch, _: append_new(batch, target, key, bucket_rows=bucket_rows)
    return records.writeStream.foreachBatch(append).option("checkpointLocation", state).trigger(availableNow=True).start()
