"""Session defaults and the shared folder for tables written between stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", memory: str = "16g", app: str = "wordreel") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="wordreel-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    On a cluster that is spark.checkpoint.dir. A local session that names none
    keeps its stages beside its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def stage_dir(spark: SparkSession) -> str:
    """Where this application's stages lie."""
    return os.path.join(shared_dir(spark), "wordreel", spark.sparkContext.applicationId)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder among this application's stages."""
    return os.path.join(stage_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where two branches of a plan need the same computed rows. Parquet
    keeps column pruning for the second reader, and a lost executor costs a
    re-read instead of the whole lineage. The results of a run read these
    tables, so they stay until `drop_stages`.
    """
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store; none if it is not there."""
    at, store = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, store = _store(spark, path)
    store.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    at, store = _store(spark, path)
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole or not at all, and only if it is not there yet."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at, store = _store(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = store.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(at), none)
    except Exception as e:
        store.delete(draft, False)
        raise FileExistsError(f"{path} is there already; another writer was first") from e


def drop_stages(spark: SparkSession) -> None:
    """Remove all stages of this application, once its results are written."""
    remove(spark, stage_dir(spark))
