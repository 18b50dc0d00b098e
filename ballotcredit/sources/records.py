"""CSV records whose quoted cells hold line breaks, found in all splits of a file at once.

A line break inside a quoted cell looks like the end of a record, and a task that starts in the
middle of a file cannot see which it is. It depends on one bit: whether the number of quotes before
it is odd. So quotes are counted per split first, the counts of the splits before give each split
its bit, and every task then cuts its own lines into records. Only records that go on in another
split meet in a shuffle, as two pieces a split at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEAD, TAIL, WHOLE = 0, 1, 2
RECORDS = "file long, block long, row long, part int, record binary"


@dataclass
class _Split:
    """The lines of a split as they come: where it stands, and the record it has begun."""

    key: tuple[int, int]
    open: bool
    row: int = 0
    began: int = 0
    begun: list[bytes] = field(default_factory=list)
    own: bool = True  # the begun record starts in this split

    def __post_init__(self):
        self.own = not self.open


def _cut(split: _Split, lines: pa.Array) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
    """(rows, part, records) of the next lines of a split; a record's row is that of its start."""
    quotes = pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False)
    after = (np.cumsum(quotes) + split.open) % 2 == 1
    before = np.concatenate([[split.open], after[:-1]])
    rows = np.arange(split.row, split.row + len(lines))
    alone = ~before & ~after
    if alone.any():
        yield rows[alone], WHOLE, lines.filter(pa.array(alone))
    for i in np.flatnonzero(~alone).tolist():
        if not before[i]:
            split.began, split.own = int(rows[i]), True
        split.begun.append(lines[i].as_py())
        if not after[i]:
            record = pa.array([b"\n".join(split.begun)], pa.binary())
            yield np.array([split.began]), WHOLE if split.own else HEAD, record
            split.begun, split.own = [], True
    split.row += len(lines)
    split.open = bool(after[-1])


def _unfinished(split: _Split) -> Iterator[tuple[np.ndarray, int, pa.Array]]:
    """The record that a split leaves open: begun here, or all of it inside one cell."""
    if split.begun:
        record = pa.array([b"\n".join(split.begun)], pa.binary())
        yield np.array([split.began]), TAIL if split.own else HEAD, record


def _find(open_splits: frozenset[tuple[int, int]]):
    """A function over Arrow batches of lines (file, block, value), in order in each split."""

    def found(key, parts):
        for rows, part, records in parts:
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])),
                 pa.array(rows, pa.int64()), pa.array(np.full(n, part, np.int32)), records],
                names=["file", "block", "row", "part", "record"])

    def find(batches):
        split = None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks = (batch.column(i).to_numpy() for i in (0, 1))
            change = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                key = (int(files[a]), int(blocks[a]))
                if split is None or split.key != key:
                    if split is not None:
                        yield from found(split.key, _unfinished(split))
                    split = _Split(key, key in open_splits)
                yield from found(key, _cut(split, batch.column(2).slice(a, b - a)))
        if split is not None:
            yield from found(split.key, _unfinished(split))

    return find


def _well_formed(sep: str, doubled_quotes: bool) -> str:
    """Pattern of a record whose line breaks all stand in cells that begin with a quote."""
    mark, doubled = f"\\x{ord(sep):02x}", '(?:""[^"]*+)*+' if doubled_quotes else ""
    cell = (f'(?:[ \\t]*+"[^"]*+{doubled}"(?:[^"{mark}\\n][^{mark}\\n]*+)?+'
            f'|(?:[^"{mark}\\n][^{mark}\\n]*+)?+)')
    return f"^{cell}(?:{mark}{cell})*+$"


def file_name(path: Column) -> Column:
    """A path with one slash behind its scheme: scans list and report files in different forms."""
    return F.regexp_replace(path, "^([^:/]+:)/+", "$1/")


def quoted_records(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
    doubled_quotes: bool = True,
) -> DataFrame:
    """(file, block, row, record): the records of CSV files, headers included, read by splits.

    ``file`` is a hash of the path (``file_name``); ``block`` and ``row`` say in which split of the file, and at
    which line of it, the record starts. Line breaks inside a quoted cell are part of the record; where
    it ends with a carriage return, that goes, and those inside become plain line breaks. Empty
    lines are no records. A file's first line, of block 0 and row 0, is its header.

    The files are read twice, by all tasks: for the quotes, which is a job of its own, and for the
    records; the splits in which a cell stands open at an edge are read once more. The driver holds
    these splits, two numbers for each, and there is at most one for ``maxPartitionBytes`` of
    input. Raises if a file ends inside a cell, and fails where a line break stands behind a quote
    that does not begin its cell, or behind a doubled one where ``doubled_quotes`` is off: quotes
    tell nothing in such a file. The encoding must write quotes and line breaks as ASCII does.
    """
    if len(sep) != 1 or any(c.encode(encoding) != c.encode() for c in f'"\n{sep}'):
        raise ValueError(f"records cannot be found in {encoding} or between {sep!r}")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(file_name(F.col("_metadata.file_path"))).alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    text = F.col("value").cast("string")
    quotes = F.octet_length(text) - F.octet_length(F.replace(text, F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    states = splits.withColumn("end", F.sum("odd").over(order) % 2).withColumn(
        "start", (F.col("end") + F.col("odd")) % 2).withColumn(
        "last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    edges = [(r.file, r.block, r.start, r.end, r.last)
             for r in states.where("start = 1 OR end = 1").collect()]
    if any(end and last for _, _, _, end, last in edges):
        raise ValueError(f"{path}: a quoted cell is open at the end of the file")

    find = _find(frozenset((f, b) for f, b, start, _, _ in edges if start))
    records = lines.mapInArrow(find, RECORDS).where(f"part = {WHOLE}").drop("part")
    if edges:
        blocks = sorted({b for _, b, _, _, _ in edges})
        parts = lines.where(F.col("block").isin(blocks)).mapInArrow(find, RECORDS).where(
            f"part <> {WHOLE}")
        # A record is a tail and the heads that follow it, up to the next tail.
        ordered = Window.partitionBy("file").orderBy("block", "part")
        joined = (
            parts.withColumn("number", F.sum(F.when(F.col("part") == TAIL, 1).otherwise(0)).over(ordered))
            .groupBy("file", "number")
            .agg(F.sort_array(F.collect_list(F.struct("block", "part", "row", "record"))).alias("all"))
            .select("file", F.col("all")[0]["block"].alias("block"), F.col("all")[0]["row"].alias("row"),
                    F.expr("CAST(array_join(transform(all, x -> CAST(x.record AS STRING)), '\n') "
                           "AS BINARY)").alias("record"))
        )
        records = records.unionByName(joined)
    return records.select("file", "block", "row", _decoded(encoding).alias("record")).where(
        "record <> ''").withColumn("record", F.when(
            ~F.contains("record", F.lit("\n")) | F.col("record").rlike(_well_formed(sep, doubled_quotes)),
            F.col("record")).otherwise(F.raise_error(F.concat(
                F.lit(f"{path}: a line break behind a quote inside a cell, at byte "),
                F.col("block"), F.lit(" and line "), F.col("row")))))


def _decoded(encoding: str) -> Column:
    """The record as text, without the carriage returns of its line breaks if it ends with one."""
    raw = F.col("record")
    text = raw.cast("string") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(raw, encoding)
    return F.when(F.endswith(text, F.lit("\r")), F.regexp_replace(text, "\r(\n|\\z)", "$1")).otherwise(text)
