"""Snapshots, panels, reports, and the folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def use_work_folder(path: str) -> None:
    """Name the folder for intermediate tables for sessions that leave ``spark.checkpoint.dir``
    unset; all executors must see it."""
    _own["base"] = path


def work_root(spark: SparkSession) -> str:
    """The run's folder for intermediate tables, below ``spark.checkpoint.dir``.

    Raises when neither that setting nor ``use_work_folder`` names a folder, on any master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get("base")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/ballotcredit-{spark.sparkContext.applicationId}"


def work_folder(spark: SparkSession) -> str:
    """A new folder name for an intermediate table; the run's folder goes when its driver ends."""
    root = work_root(spark)
    if root not in _own:
        _own[root] = root
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Delete the run's intermediate tables; frames that read them are void afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a written table: cuts its lineage and survives lost executors."""
    path = f"{work_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(table: DataFrame) -> bool:
    """Whether the files that a written table reads are still there."""
    spark = table.sparkSession
    paths = [spark._jvm.org.apache.hadoop.fs.Path(name) for name in table.inputFiles()]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def snapshot(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("ano",),
    only: Mapping[str, Sequence] | None = None,
) -> None:
    """Write a table as Parquet folders by ``partition_by``.

    The rebalance hint lets adaptive execution split large partitions over several tasks and merge
    small ones, so one large year neither ends in one task nor in a file per task.

    With ``only``, as {"ano": [2014]}, the rows and folders of these values are replaced and all
    others stay as they are, files included; rows of other values are not written. Spark stages the
    new folders and moves each into its place when the job commits; folders of these values that got
    no rows go last. A call that fails in between is simply made again.
    """
    rows = df.hint("rebalance", *partition_by)
    if only is None:
        rows.write.partitionBy(*partition_by).mode("overwrite").parquet(path)
        return
    if not only or set(only) - set(partition_by):
        raise ValueError(f"only some of {list(partition_by)} can be replaced")
    for name, values in only.items():
        rows = rows.where(F.col(name).isin(*values))
    before = _partition_files(df.sparkSession, path)
    rows.write.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).mode(
        "overwrite").parquet(path)
    wanted = {name: {str(v) for v in values} for name, values in only.items()}
    after = _partition_files(df.sparkSession, path)
    for folder in [f for f, files in after.items() if before.get(f) == files]:
        held = dict(part.split("=", 1) for part in folder.split("/") if "=" in part)
        if all(unquote(held[name]) in values for name, values in wanted.items()):
            stale = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
            stale.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(stale, True)


def _partition_files(spark: SparkSession, path: str) -> dict[str, frozenset[str]]:
    """The data files of each partition folder below ``path``, by its relative name."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    base = fs.getFileStatus(root).getPath().toUri().getPath().rstrip("/") + "/"
    found: dict[str, set[str]] = {}
    files = fs.listFiles(root, True)
    while files.hasNext():
        name = files.next().getPath().toUri().getRawPath()
        folder, _, file = unquote(name).removeprefix(base).rpartition("/")
        if folder and not any(part[0] in "._" for part in (*folder.split("/"), file)):
            found.setdefault(folder, set()).add(file)
    return {folder: frozenset(names) for folder, names in found.items()}


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    """CSV with a header; missing values are written as NA."""
    df.write.mode("overwrite").option("header", True).option("sep", sep).option(
        "encoding", encoding
    ).option("nullValue", "NA").option("escape", '"').csv(path)


def write_panel(
    panel: DataFrame, path: str, channel: str, elections: Sequence[int] | None = None
) -> None:
    """Write a panel below ``path`` by channel, sample (if it has samples) and election.

    The folders of other channels stay as they are, and with ``elections`` also those of all
    others: one more election is added, or one is written again, without the rest of the panel.
    """
    by = [c for c in ("sample", "ano") if c in panel.columns]
    snapshot(panel, f"{path}/canal={channel}", by,
             None if elections is None else {"ano": list(elections)})


def write_report(table: DataFrame, path: str) -> None:
    """A formatted report table as CSV."""
    write_csv(table, path)
