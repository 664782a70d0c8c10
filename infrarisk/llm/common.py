"""Shared helpers: reading tables, written intermediate tables, numbers of partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, importable

#: An id that sorts after every real one; stands for a null ``doc_id`` in orders and keys.
LAST_ID = 2**63 - 1


#: Rows of an Arrow batch, at most: documents are wide rows, and a batch is what a Python worker holds at once.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """The session as these operators want it: importable package, Arrow batches that fit wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(BATCH_ROWS if now <= 0 else min(now, BATCH_ROWS)))
    return importable(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Helper tables that this process has written and not yet removed.
_HELPERS: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _HELPERS.add(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.helper_path = path
    return made


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _HELPERS.discard(path)


def discard(*helpers: DataFrame) -> None:
    """Removes tables of ``written`` that no plan will read again."""
    for df in helpers:
        _removed(df.sparkSession, df.helper_path)


def helpers() -> set[str]:
    """Paths of the helper tables that stand now."""
    return set(_HELPERS)


def release(docs: DataFrame, paths: set[str]) -> None:
    """Removes those helper tables among ``paths`` that ``docs`` does not read."""
    read = docs.inputFiles()
    for path in sorted(paths & _HELPERS):
        if not any(path.rsplit("/", 1)[-1] in f for f in read):
            _removed(docs.sparkSession, path)


FILTER_BITS = 1 << 25  # of the largest filter below: half a million rows of two numbers
FEW_ROWS = 1_000_000  # a table of one number a row is broadcast up to this many


def prefiltered(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``wanted``: a semi-join still has to follow, but on far fewer rows.

    The keys' hashes become a bitmap of 16 bits a key, ``FILTER_BITS`` at most, as a broadcast table of 64-bit words.
    A set bit may be another key's; no wanted row is lost.  Without use once the bitmap is full: then ``df`` itself.
    """
    n = wanted.count()
    if 2 * n > FILTER_BITS:
        return df
    bits = min(FILTER_BITS, 1 << max(16, int(16 * n).bit_length()))
    hashed = lambda c: F.xxhash64(F.col(c)).bitwiseAND(F.lit(bits - 1))
    words = (wanted.select(hashed(wanted_key).alias("h_")).select(F.shiftright("h_", 6).alias("at_"), F.expr("shiftleft(1L, cast(h_ & 63 as int))").alias("bit_"))
             .groupBy("at_").agg(F.bit_or("bit_").alias("bits_")))
    marked = df.withColumn("h_", hashed(key)).join(F.broadcast(words), F.shiftright("h_", 6) == F.col("at_"))
    return marked.where(F.expr("(bits_ & shiftleft(1L, cast(h_ & 63 as int))) <> 0")).select(*df.columns)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Total UTF-8 bytes of a text column (null: 0); sizes buckets and blocks."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def named(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with underscores in front until it clashes with no column of ``taken`` and with no other."""
    out: list[str] = []
    for n in names:
        out.append(fresh(n, [*taken, *out]))
    return out


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until it clashes with no column of ``taken`` (case-insensitively)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
