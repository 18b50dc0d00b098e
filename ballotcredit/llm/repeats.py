"""Suffix-array dedup: bytes of strings that also start earlier in the corpus are removed.

A difference-cover suffix array (``suffixes``) sorts the suffixes and compares neighbours. One array
over every byte would shuffle each suffix some seven times, so the corpus is first cut, without
loss, into independent parts. A window of ``length`` bytes belongs to the class of its least k-gram
hash; equal windows hold the same k-grams and share their class. Neighbouring windows of one class
form a run, whose span is the text that they cover.

1. Classes met once hold no repeat and go: this leaves the runs in text that may repeat.
2. Equal spans become one, at the earliest place; all windows of the others start earlier too.
3. Classes with several spans are dealt to tasks, which build suffix arrays over blocks of whole
   classes; neighbours with the same ``length`` bytes form groups, whose earliest start stays.
   A class of very many spans, as next to a passage that all documents share, is first cut again
   into classes of whole windows, so that no class is long.
4. The windows that start earlier elsewhere are joined to their documents and their bytes cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, raw_texts, without, written_clean
from ballotcredit.llm.suffixes import first_starts

PART = 1 << 20  # bytes of text that are hashed, or sorted, at a time
MOST_WINDOWS = 256  # of one run; longer ones, in periodic text, are several runs
MOST_SPANS = 4096  # of one class in a suffix array; beyond, classes of whole windows
# Odd multipliers of the rolling hash and of its mixing.
ROLL, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of the k bytes from each position on, joined from powers of two."""
    power, size, done, n = text.astype(np.uint64) + np.uint64(7), 1, 0, len(text) - k + 1
    whole = np.zeros(n, np.uint64)
    while size <= k:
        if k & size:
            whole = whole * np.uint64(pow(ROLL, size, 1 << 64)) + power[done:done + n]
            done += size
        if size * 2 <= k:
            power = power[:-size] * np.uint64(pow(ROLL, size, 1 << 64)) + power[size:]
        size *= 2
    whole ^= whole >> np.uint64(32)
    whole *= MIX
    return whole ^ (whole >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    size, n = 1, len(values) - width + 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size:width - size + n])


def runs(raw: bytes, ends: np.ndarray, length: int, k: int):
    """(class, start, windows, several) of each run in ``raw``, whose texts end at ``ends``.

    ``several`` marks runs in which the least gram stands more than once: only those can hold
    equal windows within themselves.
    """
    grams = _gram_hashes(np.frombuffer(raw, np.uint8), k)
    least = _least(grams, length - k + 1)
    at = np.arange(len(least))
    last = ends[np.searchsorted(ends, at, "right")] - length  # of the text that holds the window
    at = at[at <= last]
    if not len(at):
        return (at,) * 4
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]])
    heads = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - heads[number]) % MOST_WINDOWS == 0
    wide = number  # runs before long ones are cut
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(at)))
    # The least gram of a run stands again behind a window that starts at it and isn't the last.
    again = np.zeros(len(at), bool)
    again[:-1] = (grams[at] == least[at])[:-1] & (wide[1:] == wide[:-1])
    several = np.zeros(wide[-1] + 1, bool)
    several[wide[again]] = True
    return least[at[heads]].view(np.int64), at[heads], counts, several[wide[heads]]


def _parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(row, offset in its text, end) of pieces of about ``PART`` bytes, with their bytes.

    Pieces of a long text overlap by ``length - 1`` bytes, so that each window is in one of them.
    """
    rows, offsets, ends, held = [], [], [], bytearray()
    for row, raw in enumerate(texts):
        for offset in range(0, max(0, len(raw) - length + 1), PART):
            held += raw[offset:offset + PART + length - 1]
            rows.append(row)
            offsets.append(offset)
            ends.append(len(held))
            if len(held) >= PART:
                yield np.array(rows), np.array(offsets), np.array(ends), bytes(held)
                rows, offsets, ends, held = [], [], [], bytearray()
    if rows:
        yield np.array(rows), np.array(offsets), np.array(ends), bytes(held)


def _classes(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(class, places): one row per class and part, with 2 places for several."""

    def count(batches):
        for batch in batches:
            for _, _, ends, raw in _parts(raw_texts(batch.column(0)), length):
                found, _, _, several = runs(raw, ends, length, k)
                names, first, n = np.unique(found, return_index=True, return_counts=True)
                more = np.zeros(len(names), bool)
                more[np.searchsorted(names, found[several])] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(1 + ((n > 1) | more), pa.int64())],
                    names=["class", "places"])

    return texts.select("text").mapInArrow(count, "class long, places long")


def _spans(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(class, span, doc, tie, start, n, several): the runs of texts (doc, tie, start, text).

    ``span`` hashes the bytes that a run covers, ``start`` counts from the text's own.
    """
    kind = texts.schema["doc"].dataType.simpleString()

    def emit(batches):
        for batch in batches:
            base = batch.column(2).to_numpy()
            for rows, offsets, ends, raw in _parts(raw_texts(batch.column(3)), length):
                found, start, n, several = runs(raw, ends, length, k)
                piece = np.searchsorted(ends, start, "right")
                begins = np.concatenate([[0], ends[:-1]])
                row = rows[piece]
                spans = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in
                         zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()),
                     pa.array(np.array(spans, np.uint64).view(np.int64)),
                     batch.column(0).take(take), batch.column(1).take(take),
                     pa.array(base[row] + offsets[piece] + start - begins[piece], pa.int64()),
                     pa.array(n.astype(np.int32)), pa.array(several)],
                    names=["class", "span", "doc", "tie", "start", "n", "several"])

    return texts.select("doc", "tie", "start", "text").mapInArrow(
        emit, f"class long, span long, doc {kind}, tie long, start long, n int, several boolean")


def _place() -> Column:
    return F.struct("doc", "tie", "start")


def _firsts(spans: DataFrame) -> DataFrame:
    """One row per different span, at its earliest place."""
    return spans.groupBy("class", "span").agg(
        F.min(_place()).alias("at"), F.min("n").alias("n"), F.max("several").alias("several"),
        F.count(F.lit(1)).alias("copies"))


def _later(spans: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc, tie, start, n) of the runs whose span stands at an earlier place."""
    repeated = firsts.where("copies > 1").select("class", "span", "at")
    return spans.join(repeated, ["class", "span"]).where(~_place().eqNullSafe(F.col("at"))).select(
        "doc", "tie", "start", "n")


def _blocks(batches) -> Iterator[pa.Table]:
    """Rows sorted by class as tables of whole classes, of ``PART`` bytes of text or one class."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        names = held["class"].to_numpy()
        sizes = np.cumsum([len(t) for t in held["text"].to_pylist()])
        at = 0
        for edge in (np.flatnonzero(names[1:] != names[:-1]) + 1).tolist():
            if sizes[edge - 1] - (sizes[at - 1] if at else 0) >= PART:
                yield held.slice(at, edge - at)
                at = edge
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def _earlier_elsewhere(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, tie, start, n) of windows in pieces that stand earlier in a piece of their class."""
    kind = pieces.schema["doc"].dataType.simpleString()

    def find(batches):
        for block in _blocks(batches):
            order = pc.sort_indices(
                block, sort_keys=[(c, "ascending") for c in ("doc", "tie", "start")],
                null_placement="at_start")
            block = block.take(order).combine_chunks()
            texts = block["text"].to_pylist()
            n = block["n"].to_numpy().astype(np.int64)
            begins = np.cumsum([0] + [len(t) for t in texts[:-1]])
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            windows = np.repeat(begins, n) + inside
            gone = np.flatnonzero(first_starts(b"".join(texts), windows, length) != windows)
            if not len(gone):
                continue
            row = np.repeat(np.arange(len(n)), n)[gone]
            start = block["start"].to_numpy()[row] + inside[gone]
            head = np.flatnonzero(np.concatenate(
                [[True], (np.diff(row) != 0) | (np.diff(start) != 1)]))
            yield from pa.Table.from_arrays(
                [block["doc"].take(pa.array(row[head])), block["tie"].take(pa.array(row[head])),
                 pa.array(start[head], pa.int64()),
                 pa.array(np.diff(np.append(head, len(row))).astype(np.int32))],
                names=["doc", "tie", "start", "n"]).combine_chunks().to_batches()

    return pieces.repartition("class").sortWithinPartitions("class").select(
        "class", "doc", "tie", "start", "n", "text").mapInArrow(
        find, f"doc {kind}, tie long, start long, n int")


def repeated_windows(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(doc, tie, start, n): runs of windows of texts (doc, tie, text) that also start earlier."""
    texts = texts.withColumn("start", F.lit(0).cast("long"))
    repeated = (_classes(texts, length, k).groupBy("class").agg(F.sum("places").alias("places"))
                .where("places > 1").select("class"))
    spans = written_clean(_spans(texts, length, k).join(
        repeated.hint("shuffle_hash"), "class", "left_semi"))
    firsts = written_clean(_firsts(spans))
    mixed = firsts.groupBy("class").agg(
        F.count(F.lit(1)).alias("spans"), F.max("several").alias("any")).where("spans > 1 OR any")
    wanted = (
        firsts.join(mixed.select("class", "spans"), "class")
        .select("class", "spans", "at.doc", "at.tie", "at.start", "n")
        .groupBy("doc", "tie").agg(F.collect_list(F.struct("class", "spans", "start", "n")).alias("w"))
        .select(F.col("doc").alias("doc_"), F.col("tie").alias("tie_"), "w")
    )
    kind = texts.schema["doc"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            lists = batch.column(3)
            row = pc.list_parent_indices(lists)
            flat = pc.list_flatten(lists)
            start, n = (pc.struct_field(flat, c).to_pylist() for c in ("start", "n"))
            raw = raw_texts(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [pc.struct_field(flat, "class"), pc.struct_field(flat, "spans"),
                 batch.column(0).take(row), batch.column(1).take(row), pa.array(start, pa.int64()),
                 pa.array(n, pa.int32()),
                 pa.array([raw[i][a:a + m + length - 1]
                           for i, a, m in zip(row.to_pylist(), start, n, strict=True)], pa.binary())],
                names=["class", "spans", "doc", "tie", "start", "n", "text"])

    pieces = written_clean(
        texts.join(wanted, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("tie") == F.col("tie_")))
        .select("doc", "tie", "text", "w").mapInArrow(
            cut, f"class long, spans long, doc {kind}, tie long, start long, n int, text binary"))
    hot = pieces.where(F.col("spans") > MOST_SPANS)
    windows = _spans(hot, length, length)
    return (
        _later(spans, firsts)
        .unionByName(_earlier_elsewhere(pieces.where(F.col("spans") <= MOST_SPANS), length))
        .unionByName(_later(windows, _firsts(windows)))
    )


def _cut(raw: bytes, starts: np.ndarray, counts: np.ndarray, length: int):
    """(bytes that stay, bytes removed, maximal removed runs)."""
    order = np.argsort(starts)
    a, b = starts[order], (starts + counts)[order] + length - 1
    reach = np.maximum.accumulate(b)
    head = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
    begin, end = a[head], reach[np.append(head[1:], len(a)) - 1]
    kept, at = [], 0
    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
        kept.append(raw[at:x])
        at = y
    kept.append(raw[at:])
    return b"".join(kept), int((end - begin).sum()), len(begin)


def remove_repeats(
    docs: DataFrame,
    length: int = 100,
    k: int = 32,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with kept (the bytes that stay), n_bytes, n_removed and n_spans, which replace
    columns of these names.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes covers it that also starts
    earlier: in a document of smaller id or, overlaps included, earlier in the same one. Strings are
    judged on the input. ``n_spans`` counts maximal removed runs. ``k`` sets the grams that cut
    the work into classes, not the result.

    A missing or empty text has no bytes; texts under ``length`` bytes stay whole. A missing id
    comes before all others. Rows that repeat an id come in an order given by a hash of their texts;
    of equal rows one counts as the first, and all others lose every byte that a string covers. An
    empty table gives none.
    """
    if not 1 <= k <= length:
        raise ValueError("the grams must be at least one byte and no longer than the strings")
    names = ["kept", "n_bytes", "n_removed", "n_spans"]
    source = without(docs, names)
    key, tie, found, made, seen = (fresh(source.columns, n) for n in
                                   ("key_", "tie_", "found_", "made_", "seen_"))
    ids = source.select(column(source, doc_id).alias("doc"))
    shared = not ids.groupBy("doc").count().where("count > 1").isEmpty()
    bytes_ = column(source, text).cast("binary")
    order = F.coalesce(F.xxhash64(bytes_), F.lit(0)) if shared else F.lit(0).cast("long")
    keyed = source.withColumn(tie, order)
    texts = keyed.where(F.octet_length(column(keyed, text)) >= length).select(
        column(keyed, doc_id).alias("doc"), column(keyed, tie).alias("tie"),
        column(keyed, text).alias("text"))
    gone = written_clean(repeated_windows(texts, length, k).groupBy("doc", "tie").agg(
        F.collect_list(F.struct("start", "n")).alias(found)).withColumnsRenamed(
        {"doc": key, "tie": key + "t"}))

    @F.arrow_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def apply(texts: pa.Array, windows: pa.Array, copies: pa.Array) -> pa.Array:
        out = []
        offsets = windows.offsets.to_numpy()
        start = pc.struct_field(windows.values, "start").to_numpy(zero_copy_only=False)
        n = pc.struct_field(windows.values, "n").to_numpy(zero_copy_only=False)
        for i, (raw, copy) in enumerate(zip(raw_texts(texts), copies.to_pylist(), strict=True)):
            a, b = (offsets[i], offsets[i + 1]) if windows[i].is_valid else (0, 0)
            if copy > 1 and len(raw) >= length:
                out.append((b"", len(raw), len(raw), 1))
            elif a == b:
                out.append((raw, len(raw), 0, 0))
            else:
                kept, lost, spans = _cut(raw, start[a:b], n[a:b].astype(np.int64), length)
                out.append((kept, len(raw), lost, spans))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        parts = zip(*out, strict=True) if out else ((),) * 4
        return pa.StructArray.from_arrays(
            [pa.array(p, kind) for p, kind in zip(parts, kinds, strict=True)], names=names)

    joined = keyed.join(gone, column(keyed, doc_id).eqNullSafe(F.col(key))
                        & (column(keyed, tie) == F.col(key + "t")), "left")
    copy = F.lit(1)
    if shared:
        by = Window.partitionBy(column(joined, doc_id), column(joined, tie))
        joined = joined.withColumn(seen, F.row_number().over(by.orderBy(F.lit(0))))
        copy = column(joined, seen)
    result = joined.withColumn(made, apply(column(joined, text), F.col(found), copy))
    return result.select([column(result, c) for c in source.columns] + [f"{made}.*"])
