"""What the corpus operators share: tables, word patterns, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but the ASCII white space \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of at most so many narrow rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: A side with strings or lists is broadcast up to so many bytes of them.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch where a stage needs its memory for other things; Spark's own default is 64 MB.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, where all run on one machine, may do without it: it gets a checkpoint folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomwork-')}")
    return context.getCheckpointDir().get()


#: The tables of each open ``passing`` block, the innermost last; every thread has its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows, written once to the shared folder and read from there: a lost executor loses none of them.

    Inside ``passing`` the table is dropped at the end of the block; one that is to be kept belongs to the block around
    it, and stays if there is none.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what ``written`` wrote inside; what is returned may read only tables that are kept."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def light_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of at most so many bytes in the Python stages that are written inside; the session's own bound is put back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if a count finds it within the bound, else as it is for a shuffle join.

    For tables of numbers and short keys only: their bytes follow from their rows. ``light`` measures the others.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def light(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if the sum of its rows' sizes in bytes is within the bound."""
    total = df.agg(F.sum(size + 64).alias("n")).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words of ``WORD``; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
