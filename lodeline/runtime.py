"""Session, table access and shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_SCOPES: list[str] = []
_SHIPPED: set[str] = set()


def session(app: str = "lodeline", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; on a cluster the submitted configuration wins."""
    b = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; the scan prunes columns and takes pushed filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests; ``local-cluster`` is a cluster."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. A cluster without that setting is an error; a session on one machine, as in tests, gets a folder of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not on_one_machine(spark):
        raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lodeline-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


def _own(spark: SparkSession) -> str:
    """This application's folder within the shared one, or the current :func:`scope`'s within it."""
    return "/".join([f"{shared_dir(spark)}/lodeline-{spark.sparkContext.applicationId}", *_SCOPES])


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables stored within end with the block; write or collect results before it closes."""
    _SCOPES.append(uuid.uuid4().hex)
    folder = _own(spark)
    try:
        yield
    finally:
        _SCOPES.pop()
        _delete(spark, folder)


def ship(spark: SparkSession) -> None:
    """Send the package to all executors once, so that their Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or on_one_machine(spark):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodeline-code-")  # on the driver, which serves the file until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan gives fewer tasks than there are cores, as one small file does; else as it is.

    For scans ahead of Python work only: what is moved is less than one task's share for each core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def clear(spark: SparkSession) -> bool:
    """Delete the tables that this application has stored; results that still read them end with it."""
    return _delete(spark, f"{shared_dir(spark)}/lodeline-{spark.sparkContext.applicationId}")


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: whatever is computed from the result never recomputes ``df``, and a lost
    executor costs only a re-read, since the files live outside the executors.
    """
    spark = df.sparkSession
    path = f"{_own(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sliced(rows: Iterator[tuple], schema: pa.Schema, size: int = 16_384) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` of the rows, for Python work that makes many rows of one: only one slice is held at a time."""
    while some := list(itertools.islice(rows, size)):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that mustn't broadcast it. Spark's estimates miss by far: rows made in Python count as large as what they're made of, stored tables as packed on disk."""
    return df.hint("merge")


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Internal column names that clash with no column of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        x = f"__{name}"
        while x.lower() in taken:
            x = "_" + x
        taken.add(x.lower())
        out.append(x)
    return out


def col(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
