"""What several operators need of a session: shared storage to cut lineage with, and skew-proof lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: with it, an execution's shuffle files go when it ends, not when the driver happens to collect garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN_DIRS: dict[str, str] = {}
_ROOTS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all executors are in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share; a folder of this machine wouldn't do on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="citeweave-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


class Workspace:
    """Intermediate tables of one query, written to the shared folder.

    A written table survives the loss of any executor and cuts the lineage; ``drop`` frees one that a later table replaces.
    """

    tables = 0  # written in this process so far

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/citeweave-{name}-{uuid.uuid4().hex}"
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        self._n = 0

    def write(self, df: DataFrame, **metrics: str) -> DataFrame:
        """The table as written; its attribute ``metrics`` has the aggregates (in SQL) asked for, taken while writing."""
        self._n += 1
        Workspace.tables += 1
        path = f"{self.root}/{self._n}"
        seen = Observation() if metrics else None
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")  # a table once written needs none of the shuffles that made it
        try:
            (df.observe(seen, *[F.expr(c).alias(k) for k, c in metrics.items()]) if metrics else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._citeweave_path, out.metrics = path, seen.get if metrics else {}
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that nothing reads any more."""
        for df in tables:
            if path := getattr(df, "_citeweave_path", None):
                _delete(self.spark, path)

    def clear(self) -> None:
        """Frees all tables of this workspace, once nothing reads any of them."""
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Frees all intermediate tables of this application: for a caller that has written the results it needs.

    A result is lazy and reads its last tables, so no operator can do this itself. Each drops those it replaces on the way.
    """
    for root in _ROOTS.pop(spark.sparkContext.applicationId, []):
        _delete(spark, root)


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Frees, at the end of the block, the tables of all workspaces made in it: for a result written to one made before."""
    roots = _ROOTS.setdefault(spark.sparkContext.applicationId, [])
    n = len(roots)
    yield
    for root in roots[n:]:
        _delete(spark, root)
    del roots[n:]


def tasks(spark: SparkSession) -> int:
    """Partitions for a stage whose cost is in Python rather than in bytes: enough for every core, no fewer than shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` (a scan) over all cores, if it has too few partitions of its own; a large table is left where it lies."""
    spark = table.sparkSession
    if table.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism:
        return table
    return table.repartition(tasks(spark), *keys)


def numbered(ws: Workspace, df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with ``name``, the number from 0 of each row among those of its ``keys`` by ``order``.

    Like row_number, but no task gets all rows of a key: rows are range-partitioned by keys and order, numbered within each
    partition, and moved on by the key's rows in partitions before. Nulls are a key; null orders come first.
    """
    part = F.spark_partition_id().alias("_part")
    rows = ws.write(df.repartitionByRange(*keys, *order).select("*", part))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).where("_before > 0").drop("_n")
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    same = [own[k].eqNullSafe(before[k]) for k in [*keys, "_part"]]
    # a partition begins with at most one key that partitions before it hold, too, so ``before`` has no more rows than there are partitions
    return own.join(F.broadcast(before), same, "left").select(*[own[c] for c in df.columns], (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))


def hot_keys(counts: DataFrame, key: str, n: str, share: float = 1 / 512) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: never more than 1/share of them, so safe to broadcast.

    A key of up to 10,000 rows isn't worth spreading. Neither number changes a result.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.where(F.col(n) > max(total * share, 10_000)).select(key)


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, n: str, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row a key) where a key may hold a third of all rows.

    Rows of hot keys (by ``counts``) are spread over ``salts`` copies of their table row; all others move once.
    """
    hot = F.broadcast(hot_keys(counts, key, n).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    right = table.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_salt"]).drop("_salt")
