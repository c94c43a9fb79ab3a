"""Shared scratch tables: cut lineage by writing to the folder the session names."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_FIT_TASK = 5_000
SMALL_WAVES = 20
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; a temporary folder only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = context.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="tabulens-")
        # Boosting cuts its lineage by checkpoints; a session with spark.checkpoint.dir already has this set.
        context.setCheckpointDir(_own_folders[app])
    return _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path; everything of one application lies in one folder that can be dropped when it ends."""
    return f"{shared_folder(spark)}/tabulens-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that `written` made, on whatever file system it lies."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The tables written inside the `with` block go when it ends, but for those in `keep`.

    What is read lazily after the block has to be kept; what has been written from a dropped table stays as it is. Blocks
    nest: a table belongs to the innermost block of the thread that writes it.
    """

    _open = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """`df`, a table from `written`, outlives this block and belongs to the next one outside."""
        self.kept.add(df._scratch_path)
        return df

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this block before it ends."""
        for df in tables:
            if df._scratch_path in self.paths:
                self.paths.remove(df._scratch_path)
                dropped(self.spark, df._scratch_path)

    def __enter__(self) -> Scratch:
        self.outer = getattr(self._open, "scope", None)
        Scratch._open.scope = self
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.scope = self.outer
        for path in self.paths:
            if path not in self.kept:
                dropped(self.spark, path)
            elif self.outer is not None:
                self.outer.paths.append(path)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write the frame once as Parquet and read it back: one computation, short lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    scope = getattr(Scratch._open, "scope", None)
    if scope is not None:
        scope.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def small_for_fitting(spark: SparkSession, rows: int) -> bool:
    return rows <= ROWS_PER_FIT_TASK * spark.sparkContext.defaultParallelism * SMALL_WAVES


def written_for_fitting(df: DataFrame, rows: int, name: str = "train") -> DataFrame:
    """Written for a fit that passes over it many times.

    A table small for the cluster is spread evenly over as many tasks as its rows fill; a large one keeps the
    partitions it has.
    """
    if small_for_fitting(df.sparkSession, rows):
        cores = df.sparkSession.sparkContext.defaultParallelism
        df = df.repartition(max(1, min(cores, rows // ROWS_PER_FIT_TASK)))
    return written(df, name)


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result table of a few (schema-sized) rows."""
    return spark.createDataFrame(rows, schema)
