"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a table may have to be joined by broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: Tables of this process in the shared folder that nobody has released yet.
_tables: list[str] = []


#: Lets Spark delete the shuffle files of a query when it ends; those of a written table are never read again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short lineage that outlives lost executors.

    Its shuffle files go once it is written. ``release`` deletes the tables once the results that read them are written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a query takes the setting when it is built
    finally:
        spark.conf.set(CLEANUP, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Delete the tables that ``saved`` has written, but for the first ``since`` and the ``last`` ones.

    Nothing that reads them may run after this.
    """
    stop = len(_tables) - last
    for name in _tables[since:stop]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    del _tables[since:stop]


def written() -> int:
    """Number of tables that ``saved`` has written and nobody has deleted, for ``release(since=...)``."""
    return len(_tables)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents that no model learns from; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def small(df: DataFrame) -> DataFrame:
    """Mark a saved table for broadcast where its row count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hash_bits(key: Column, digits: int) -> Column:
    """The first ``digits`` hexadecimal digits of the key's MD5 as a number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, digits), 16, 10).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` documents outside the held-out quarter with a 0/1 ``label``, by a hash of the id.

    The one place where data is bounded: it only feeds the fit of a classifier. Several labels of one document count
    as their largest.
    """
    ids = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
