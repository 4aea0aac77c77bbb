"""Session building, the shared scratch folder and shipping of the package."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Default of the scratch folder where the cluster names none (tests, local runs).
LOCAL_SCRATCH = "file:///tmp/corvane-scratch"
#: Paths of the tables that `materialize` wrote.
_written: list[str] = []


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, else a local one, for a local master only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_SCRATCH)
    return LOCAL_SCRATCH


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once into the scratch folder and read it back, which cuts its lineage.

    The files survive the loss of executors. They stay until `clear_scratch` or until the
    cluster clears its scratch folder.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The folder of something derived from the table at `source`, made once.

    It lies in the scratch folder under the source's path, size, number of files and time
    of change, so another table, or the same one rewritten, has a folder of its own. It is
    written aside and renamed when complete.
    """
    p, fs = _file_system(spark, source)
    seen = fs.getContentSummary(p)
    state = f"{p} {seen.getLength()} {seen.getFileCount()} {fs.getFileStatus(p).getModificationTime()}"
    target = f"{scratch_dir(spark)}/{name}-{hashlib.sha256(state.encode()).hexdigest()[:32]}"
    to, fs = _file_system(spark, target)
    if not fs.exists(to):
        aside = f"{target}-{uuid.uuid4().hex}"
        make(aside)
        # Of two sessions that make it at once one is first; the other's copy goes.
        if not fs.exists(to):
            fs.rename(_file_system(spark, aside)[0], to)
        else:
            fs.delete(_file_system(spark, aside)[0], True)
    return target


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables that this session wrote by `materialize`, whose results must have been
    used; returns their number."""
    done = 0
    while _written:
        p, fs = _file_system(spark, _written.pop())
        done += bool(fs.delete(p, True))
    return done


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_corvane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="corvane-ship-")) / "corvane_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join("corvane", p.relative_to(root)))
    sc.addPyFile(str(target))
    sc._corvane_shipped = True


#: The tables whose rows carry whole texts or measures, with their keys.
_KEYS = {"documents": "doc_id", "passages": "passage_id", "predictions": "record_id", "questions": "question_id"}
#: Between these numbers of bytes a table of fewer files than there are cores is dealt out anew.
_SPREAD = (1 << 18, 1 << 28)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables.

    A small file of one row group is read by one task, and all work on its texts would stay
    there; such a table is dealt to all cores by its key. Larger ones, and those of many
    files, have splits enough and are read as they are.
    """
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    if name in _KEYS:
        p, fs = _file_system(spark, path)
        seen, cores = fs.getContentSummary(p), spark.sparkContext.defaultParallelism
        if seen.getFileCount() < cores and _SPREAD[0] <= seen.getLength() < _SPREAD[1]:
            return df.repartition(cores, _KEYS[name])
    return df
