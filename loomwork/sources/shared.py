"""The folder that driver and executors share, and tables in it that change together.

A change of several tables is staged as folders and becomes visible by one manifest: a reader takes the newest manifest and
reads only the folders that it names. Until that file is there, readers see the old state of all tables; a change that was
applied before is not applied again.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; only a plain local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def manifest(spark: SparkSession, root: str) -> dict:
    """The newest state: its number, the folders of each table, and the changes applied with their counts."""
    fs, at = _file_system(spark, f"{root}/_manifest")
    names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
    names = [n for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
    if not names:
        return {"number": 0, "tables": {}, "applied": {}}
    return json.loads(spark.read.text(f"{root}/_manifest/{names[-1]}", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, state: dict) -> None:
    """Write the manifest aside and rename it to its number, which fails if another change took that number first."""
    fs, aside = _file_system(spark, f"{root}/_manifest/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest/{state['number']:012d}.json")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, final, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))


def current(spark: SparkSession, root: str, table: str, schema: StructType, state: dict | None = None) -> DataFrame:
    """A table as the newest manifest has it; empty if there is none."""
    parts = (state or manifest(spark, root))["tables"].get(table, [])
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def applied(spark: SparkSession, root: str, change: str, tables: Mapping[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """Insert rows whose key a table does not have, into all tables at once; how many went into each.

    ``tables``: rows and their key by name, in the order in which they are staged. Of rows with one key one is taken.
    """
    state = manifest(spark, root)
    if change in state["applied"]:
        return state["applied"][change]
    counts, staged = {}, {}
    for name, (rows, key) in tables.items():
        fresh = rows.dropDuplicates([key]).join(current(spark, root, name, rows.schema, state).select(key), key, "left_anti")
        path = f"{root}/{name}/{uuid.uuid4().hex}"
        fresh.select(rows.columns).write.parquet(path)
        counts[name] = spark.read.schema(rows.schema).parquet(path).count()
        staged[name] = path
    known = {name: [*state["tables"].get(name, []), *([staged[name]] if counts.get(name) else [])] for name in {**state["tables"], **staged}}
    _commit(spark, root, {"number": state["number"] + 1, "tables": known, "applied": {**state["applied"], change: counts}})
    return counts


#: What a call log must not hold.
CONTENT = {"prompt", "response", "content", "text", "messages", "system", "user_text"}


def logged(batch: DataFrame, batch_id: int, path: str, day: str = "day") -> None:
    """Append calls by day; a batch that comes again replaces itself, so it adds no row. For ``foreachBatch``.

    Calls with a column of content are refused: a log outlives what it was written for.
    """
    if held := CONTENT & {c.lower() for c in batch.columns}:
        raise ValueError(f"a call log has no content, but {sorted(held)}")
    rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "batch").parquet(path)
