"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A local session with the settings the operators expect; on a cluster the caller brings its own."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where a local session names none (tests), a folder of this process, removed at exit; on a cluster that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if there:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(there)
        return there
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="codeloam-")
        atexit.register(shutil.rmtree, own, True)
        context.setCheckpointDir(f"file://{own}")
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def pinned(df: DataFrame) -> DataFrame:
    """The rows, their partitions and their order as they are now, kept in the shared folder: survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder; columns that a reader does not use are not read again. Removed at exit."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/codeloam-{uuid.uuid4().hex}"
    df.write.parquet(where)
    atexit.register(_remove, spark, where)
    return spark.read.parquet(where)


def _remove(spark: SparkSession, where: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


def changed(table: pa.Table, keys: list[str]) -> pa.ChunkedArray | pa.Array:
    """For rows 1.. of the table: is any key different from the row above? Two nulls are equal."""
    out = None
    for k in keys:
        col = table.column(k).combine_chunks()
        a, b = col[1:], col[:-1]
        differs = pc.fill_null(pc.not_equal(a, b), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        differs = pc.or_(differs, pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out = differs if out is None else pc.or_(out, differs)
    return out


def whole_groups(keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], most_rows: int = 20_000) -> Callable:
    """For mapInArrow over rows sorted by keys: calls fn with tables that hold only whole groups, several at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < most_rows:
                continue
            table = pa.concat_tables(held).combine_chunks()
            ends = pc.indices_nonzero(changed(table, keys))
            if not len(ends):
                held = [table]
                continue
            cut = ends[-1].as_py() + 1
            yield from fn(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield from fn(pa.concat_tables(held).combine_chunks())

    return run


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per context, so that it need not be installed there."""
    context = spark.sparkContext
    if getattr(context, "_codeloam_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="codeloam-ship-")  # read by the driver alone, which serves it
    atexit.register(shutil.rmtree, folder, True)
    archive = f"{folder}/codeloam_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"codeloam/{p.relative_to(root)}")
    context.addPyFile(archive)
    context._codeloam_shipped = True
