"""Session helper and the shared folder for lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications that have no shared folder set, on one machine.
_own: dict[str, str] = {}


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library is tested with."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkloom")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks are one process."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine (as in tests), and an error on a cluster."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not on_one_machine(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="inkloom-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """The same rows, read back from a table written to the shared folder: a cut of the lineage that outlives executors.

    The files stay until :func:`release`, or as long as the folder does.
    """
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Gives back the space of settled tables that nothing will be read from any more; other tables are left alone.

    A folder of this machine is removed, one of another file system is left with an empty table.
    """
    for t in tables:
        path = getattr(t, "settled_at", None)
        if path is None:
            continue
        plain = path.removeprefix("file://")
        if "://" not in plain:
            shutil.rmtree(plain, ignore_errors=True)
        else:
            t.sparkSession.createDataFrame([], t.schema).coalesce(1).write.mode("overwrite").parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path doesn't have it: Spark hands them a zip of it, once a context."""
    root = Path(__file__).resolve().parent
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    sc = spark.sparkContext
    here = sc.master.startswith("local") and any(p and Path(p).resolve() == root.parent for p in places)
    if here or any(Path(f).name == "inkloom.zip" for f in sc.listFiles):
        return
    archive = Path(tempfile.mkdtemp(prefix="inkloom-")) / "inkloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
