"""What the operators of this subpackage share: lineage cuts, checked broadcasts, table reading."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that may be broadcast (8 bytes each); beyond it joins shuffle.
BROADCAST_ROWS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder that spark.checkpoint.dir names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, as in tests, a new one where that is unset. A cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; measured where it has none."""
    planned = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if planned < 1 << 50:
        return planned
    widths = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return df.agg(F.sum(sum(widths, F.lit(16)))).first()[0] or 0


def parts_for(df: DataFrame, bytes_each: int, least: int = 24) -> int:
    """Number of buckets that keeps a bucket's share of df near bytes_each, however large df is."""
    return max(least, -(-planned_bytes(df) // bytes_each))


def without(docs: DataFrame, keys: DataFrame, keep: bool = False) -> DataFrame:
    """Rows of docs whose doc_id (null-safe) and text hash are not (keep: are) among keys (doc_id, h). The keys are broadcast only below BROADCAST_ROWS."""
    keys = cut(keys.select(F.col("doc_id").alias("_key"), F.col("h").alias("_hash")).distinct())
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("_row"))  # in a struct, no column of docs clashes
    on = F.col("_row.doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64("_row.text") == F.col("_hash"))
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi" if keep else "left_anti").select("_row.*")


def fold(doc_id: Column | str, n: int = 5) -> Column:
    """crc32(doc_id as text) mod n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n
