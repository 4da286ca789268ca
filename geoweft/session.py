"""Session settings and tables that cut lineage."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings the engine expects anywhere."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("geoweft")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Where it is unset and the master is local, a temporary folder is made once and removed at exit.
    On a cluster an unset folder is an error, as no local folder would do there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIRS:
        _OWN_DIRS.append(tempfile.mkdtemp(prefix="geoweft-"))
        atexit.register(_remove_own)
    return f"file://{_OWN_DIRS[0]}"


def _remove_own() -> None:
    import shutil

    for path in _OWN_DIRS:
        shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/geoweft-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all scratch tables of this application. Data frames that read them are of no more use."""
    remove(spark, f"{shared_dir(spark)}/geoweft-{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: lineage ends there, and losing an executor costs nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As `materialize`, with the number of rows, counted while they are written."""
    seen = Observation()
    written = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return written, seen.get["n"]


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object of `path`."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, where = filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def open_file(path: str, mode: str = "rb"):
    """A file of bytes for reading or writing, by a local path or the address of a file system that pyarrow knows."""
    if "://" not in path or path.startswith("file://"):
        return open(path.removeprefix("file://"), mode)
    from pyarrow.fs import FileSystem

    fs, where = FileSystem.from_uri(path)
    return fs.open_output_stream(where) if "w" in mode else fs.open_input_file(where)


def rename_file(old: str, new: str) -> None:
    if "://" not in old or old.startswith("file://"):
        os.replace(old.removeprefix("file://"), new.removeprefix("file://"))
        return
    from pyarrow.fs import FileSystem

    fs, where = FileSystem.from_uri(old)
    fs.move(where, FileSystem.from_uri(new)[1])


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Write a small JSON file that must not exist yet: of two writers of one name the second fails, on any file system that creates exclusively."""
    fs, where = filesystem(spark, path)
    if fs.exists(where):
        raise RuntimeError(f"another writer has committed {path}")
    out = fs.create(where, False)
    out.write(bytearray(json.dumps(value), "utf-8"))
    out.close()


def numbered_json(spark: SparkSession, folder: str, start: str, number: int | None = None) -> dict | None:
    """The value of `start``number`.json, by default of the greatest number that is complete; None if there is none."""
    numbers = [number] if number is not None else sorted((int(x[len(start) : -5]) for x in list_names(spark, folder) if x.startswith(start) and x.endswith(".json")), reverse=True)
    for n in numbers:
        try:
            return read_json(spark, f"{folder}/{start}{n}.json")
        except json.JSONDecodeError:
            continue  # its writer has not finished, or never will
    return None


def read_json(spark: SparkSession, path: str) -> object:
    fs, where = filesystem(spark, path)
    source = fs.open(where)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return json.loads(data)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the knob by which a cluster sizes its tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
