"""What several operators share: reading, normalising, guarded broadcasts, shared folders."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word in the strict word rule: all of ASCII but digits and lower-case letters. Named one by one they are
#: looked up in a table by the engine of regular expressions; ranges are compared one after the other.
SEPARATORS = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isdigit() and not chr(c).islower()) + "]+"
#: Bytes of a broadcast table at most, and types whose values have a width of their own.
BROADCAST_BYTES = 64 << 20
_FIXED = {"boolean", "byte", "short", "integer", "long", "float", "double", "date", "timestamp"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every machine sees; in local mode a temporary one where that is unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = context._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = made.get() if made.isDefined() else tempfile.mkdtemp(prefix="tallyjoin-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of steps whose results are written: its cleaner hears of them only when
    the driver collects its garbage, which a driver with little to do may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and ``size`` bytes; otherwise itself, and the join shuffles.

    Both are measured here; bytes where rows have no fixed width, by what a row takes as JSON."""
    if all(f.dataType.typeName() in _FIXED for f in df.schema.fields):
        small = df.limit(rows + 1).count() <= rows
    else:
        n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).collect()[0]
        small = n <= rows and held <= size
    return F.broadcast(df) if small else df


def _importable(spark: SparkSession) -> None:
    """In local mode, let Python workers import this package wherever the driver was started. Clusters have it installed."""
    root, context = Path(__file__).resolve().parents[2], spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if not context.master.startswith("local[") or str(root) in known or "site-packages" in str(root) or getattr(context, "_tallyjoin", False):
        return
    archive = f"{tempfile.mkdtemp(prefix='tallyjoin-')}/tallyjoin.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "tallyjoin").rglob("*.py")):
            out.write(f, f.relative_to(root))
    context.addPyFile(archive)
    context._tallyjoin = True


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Before Python runs on executors: keep the batches it gets small, as one text may be long."""
    _importable(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts that are all ASCII take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Array of the lower-cased words of a text; empty for null. One pass of the separators' pattern."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
