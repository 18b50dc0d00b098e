"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other numbers or names has
the same template. Windows of template words, and of plain words for copies in another letter case,
are hashed and joined between documents and benchmark items; pairs that meet are aligned on their
whole texts, and the values behind the placeholders must map to each other consistently.

An item that is found shares many windows with the document, so it need not be looked up by all: its
most frequent windows, which many items have, are left out as far as no match can share them alone.
A document's text is sent once with the texts of up to ``TOGETHER`` items that it met.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.llm.common import column
from ballotcredit.sources.sinks import written

# Written numbers and units of measure.
NUMBER_WORDS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve
    thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty
    seventy eighty ninety hundred thousand million billion half dozen""".split())
UNITS = frozenset("""mm cm m km in inch inches ft feet foot yard yards mile miles mg g kg gram grams
    kilogram kilograms ton tons oz lb lbs pound pounds ml l liter liters litre litres gallon gallons
    s sec second seconds min minute minutes h hour hours day days week weeks month months year years
    usd eur gbp dollar dollars euro euros cent cents percent degree degrees c f k hz khz mhz ghz v w
    kw kb mb gb tb mph kmh""".split())
_EDGE = re.compile(r"^[^\w$€£+-]+|[^\w%$€£]+$")
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:st|nd|rd|th|%|[a-zA-Z]{1,3})?[$€£]?")
PLAIN, NUMBER, TITLE, UNIT, STOP = 0, 1, 2, 4, 8
_MARKS = {NUMBER: 0x1111111111111111, TITLE: 0x2222222222222222, UNIT: 0x4444444444444444}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 24
_KEPT = 100_000
TOGETHER = 64
PART = 1 << 20  # bytes of text that are read at a time: their hashes take some forty times that


class _Codes(dict):
    """Codes of tokens as written: a hash of the plain word above four bits of what it may be."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        core = _EDGE.sub("", token)
        low = core.lower()
        flags = STOP if token.rstrip("\"')]»”").endswith((".", "!", "?", ":")) else 0
        if _NUMBER.fullmatch(core) or low in NUMBER_WORDS:
            flags |= NUMBER
        elif core[:1].isupper() and core[1:2].islower():
            flags |= TITLE
        if low in UNITS:
            flags |= UNIT
        code = xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")) & ~15 | flags
        self[token] = code
        return code


_codes = _Codes()


def read_batch(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, template hash, template hash with names at sentence starts, plain hash) of each token
    of some texts, in one pass over all of them; a missing text has no tokens.

    The templates differ from the plain hash at placeholders.
    """
    lines = pc.split_pattern(texts, "\n")
    split = pc.utf8_split_whitespace(pc.list_flatten(lines))
    tokens = pc.list_flatten(split)
    whole = pc.not_equal(tokens, "")
    tokens = tokens.filter(whole).dictionary_encode()
    line = pc.list_parent_indices(split).filter(whole)
    row = pc.list_parent_indices(lines).take(line).to_numpy()
    line = line.to_numpy()
    words = tokens.dictionary.to_pylist()
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    if not len(row):
        return row, codes, codes, codes
    codes = codes[tokens.indices.to_numpy()]
    flags = (codes & np.uint64(15)).astype(np.uint8)
    opens = np.concatenate([[True], row[1:] != row[:-1]])  # the first token of a text
    starts = opens | np.concatenate([[True], (line[1:] != line[:-1]) | ((flags[:-1] & STOP) > 0)])
    plain = codes & ~np.uint64(15)
    number = (flags & NUMBER) > 0
    unit = ((flags & UNIT) > 0) & ~opens
    unit[1:] &= number[:-1]
    title = ((flags & TITLE) > 0) & ~unit
    result = plain.copy()
    result[title & ~starts] = _MARKS[TITLE]
    named = plain.copy()
    named[title] = _MARKS[TITLE]
    for marks in (result, named):
        marks[unit] = _MARKS[UNIT]
        marks[number] = _MARKS[NUMBER]
    return row, result, named, plain


def readings(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three hashes of ``read_batch`` for one text."""
    return read_batch(pa.array([text], pa.string()))[1:]


def template(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(template hash, plain hash) of each token of a text; they differ at placeholders."""
    marks, _, plain = readings(text)
    return marks, plain


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` tokens."""
    if len(hashes) < size or not size:
        return np.zeros(0, np.uint64)
    total = hashes * _MIX
    total ^= total >> np.uint64(29)
    width = 1
    while width < size:  # two runs that may overlap make a longer one
        step = min(width, size - width)
        total = total[:-step] * _MIX + total[step:]
        total ^= total >> np.uint64(29)
        width += step
    return total


def item_windows(
    text: str, size: int, least_plain: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Hashes and places of an item's windows by each of its readings, and their size: templates
    where they hold enough plain words, all windows of plain words."""
    *marked, plain = readings(text)
    size = min(size, len(plain))
    result = []
    for marks in marked:
        found = windows(marks, size)
        words = np.concatenate([[0], np.cumsum(marks == plain)])
        enough = words[size:] - words[: len(found)] >= min(least_plain, size) if len(found) else []
        places = np.flatnonzero(enough)
        result.append((found[places], places))
    found = windows(plain, size)
    return [*result, (found, np.arange(len(found)))], size


def _matches(item: tuple[np.ndarray, np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places (in the item, in the document) where windows of the same hash begin."""
    hashes, places = item
    order = np.argsort(hashes, kind="stable")
    known, where = hashes[order], places[order]
    left, right = np.searchsorted(known, doc, "left"), np.searchsorted(known, doc, "right")
    at = np.flatnonzero(right > left)
    counts = right[at] - left[at]
    first = np.repeat(left[at] - np.cumsum(counts) + counts, counts)
    return where[first + np.arange(len(first))], np.repeat(at, counts)


def _runs(i: np.ndarray, d: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(item token, document token, tokens) of each unbroken run of matches on one diagonal."""
    if not len(i):
        return []
    order = np.lexsort((i, d - i))
    i, d = i[order], d[order]
    breaks = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(i) > size)) + 1
    begin = np.concatenate([[0], breaks])
    end = np.concatenate([breaks, [len(i)]]) - 1
    return sorted(zip(i[begin].tolist(), d[begin].tolist(), (i[end] - i[begin] + size).tolist(),
                      strict=True), key=lambda r: r[1])


def _aligned(runs: list[tuple[int, int, int]], low: int, high: int,
             item_plain: np.ndarray, doc_plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of an item and of doc[low:high] matched one to one, the longest runs first, of equal
    ones those with most equal words."""
    parts = []
    for i, d, n in runs:
        cut = max(0, low - d)
        i, d, n = i + cut, d + cut, min(n, high - d) - cut
        if n > 0:
            equal = int((item_plain[i : i + n] == doc_plain[d : d + n]).sum())
            parts.append((-n, -equal, d, i))
    free_i, free_d = np.ones(len(item_plain), bool), np.ones(high - low, bool)
    left, right = [], []
    for n, _, d, i in sorted(parts):
        free = np.flatnonzero(free_i[i : i - n] & free_d[d - low : d - low - n])
        free_i[i + free] = False
        free_d[d - low + free] = False
        left.append(i + free)
        right.append(d + free)
    return np.concatenate(left), np.concatenate(right)


def leak(doc: tuple[np.ndarray, ...] | str, item: str, size: int, least_plain: int,
         ) -> tuple[float, int, int, bool, bool]:
    """How an item stands in a document, or in its readings: (coverage, first token, token after the last, consistent,
    changed), for the consistent stretch of the document that covers most of the item's tokens.

    Within a stretch each token of the item stands for one token of the document. Windows of equal
    words are judged on their own too, as other variants of the item may lie beside a copy.
    """
    item_marks, _, item_plain = readings(item)
    doc_readings = readings(doc) if isinstance(doc, str) else doc
    doc_plain = doc_readings[2]
    found, size = item_windows(item, size, least_plain)
    met = [_matches(f, windows(marks, size)) for f, marks in zip(found, doc_readings, strict=True)]
    number = len(item_marks)
    best = (False, 0.0, False, 0, 0)
    for i, d in (met[2], tuple(map(np.concatenate, zip(*met, strict=True)))):
        runs = _runs(i, d, size)
        longest = max((n for _, _, n in runs), default=0)
        first = 0
        for low in sorted({d for _, d, _ in runs}):
            while runs[first][1] + longest <= low:
                first += 1
            for high in (low + number, low + number + number // 2 + 2 * size):
                high = min(high, len(doc_plain))
                last = bisect_left(runs, high, key=lambda r: r[1])
                i, d = _aligned(runs[first:last], low, high, item_plain, doc_plain)
                slots: dict[int, Counter[int]] = {}
                other = (item_marks[i] != item_plain[i]) | (item_plain[i] != doc_plain[d])
                for k in np.flatnonzero(np.isin(item_plain[i], item_plain[i[other]])):
                    slots.setdefault(int(item_plain[i[k]]), Counter())[int(doc_plain[d[k]])] += 1
                total = sum(sum(c.values()) for c in slots.values())
                agreed = sum(c.most_common(1)[0][1] for c in slots.values())
                same = all(c.most_common(1)[0][0] == value for value, c in slots.items())
                judged = (agreed >= 0.8 * total, len(i) / number, same)
                if judged > best[:3]:
                    best = (*judged, int(d.min()), int(d.max()) + 1)
            if best[:3] == (True, 1.0, True):
                break
    consistent, covered, same, begin, end = best
    return covered, begin, end, consistent, bool(covered) and not same


def _parts(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of slices of ``PART`` bytes of text or one text, in turn."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        edge = max(at + 1, int(np.searchsorted(ends, before + PART, "right")))
        yield at, texts.slice(at, edge - at)
        at = edge


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their lowest bits in a filter of ``_bitmap``."""
    low = hashes & np.uint64((1 << _BITS) - 1)
    return (bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _bitmap(index: DataFrame) -> np.ndarray:
    """Which lowest bits the items' window hashes have: a filter of fixed size, eight to a byte."""
    width = (1 << _BITS) // 8

    def mark(frames):
        bits = np.zeros(1 << _BITS, bool)
        for frame in frames:
            bits[frame["hash"].to_numpy().astype(np.uint64) & np.uint64((1 << _BITS) - 1)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

    def merge(frames):
        bits = np.zeros(width, np.uint8)
        for frame in frames:
            for b in frame["bits"]:
                bits |= np.frombuffer(b, np.uint8)
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    parts = index.select("hash").mapInPandas(mark, "bits binary").repartition(4).mapInPandas(
        merge, "bits binary").collect()
    bits = np.zeros(width, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r.bits, np.uint8)
    return bits


def _meeting(texts: pa.Array, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """(rows, hashes): the different windows of each text that pass the filter."""
    met = [np.zeros((2, 0), np.int64)]
    for first, part in _parts(texts):
        row, *read = read_batch(part)
        rows, hashes = [], []
        for size in sizes:
            inside = row[size - 1:] == row[: max(0, len(row) - size + 1)]
            for marks in read:
                found = windows(marks, size)
                at = np.flatnonzero(inside & _marked(bits, found))
                rows.append(row[at] + first)
                hashes.append(found[at])
        if rows:
            met.append(np.unique(np.stack(
                [np.concatenate(rows), np.concatenate(hashes).view(np.int64)]), axis=1))
    return np.concatenate(met, axis=1)


def _rare_windows(index: DataFrame, coverage: float) -> DataFrame:
    """Rows of ``index`` without the windows that no match can share alone.

    A match covers ``coverage`` of an item's tokens, by windows of ``size``: it shares a number of
    its windows. The most frequent windows, whose places are fewer than that, may all be left out.
    """
    spread = index.groupBy("hash").agg(F.count(F.lit(1)).alias("items"))
    commonest = Window.partitionBy("item_id", "item").orderBy(F.desc("items"), "hash").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return index.join(spread, "hash").withColumn("passed", F.sum("places").over(commonest)).where(
        F.col("passed") * F.col("size") >= F.col("tokens") * coverage).drop("passed", "items", "item")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    least_plain: int = 4,
    coverage: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage, first_token, end_token, changed): items found in documents.

    Tokens are runs without white space, compared in lower case without punctuation at their
    edges; numbers, units after numbers, and capitalised words are placeholders; a capitalised word that
    begins a sentence or line is read both as a name and as a word. Windows of plain words are
    compared beside the templates, so copies meet whatever their letter case and line ends.
    An item is found if windows of ``window`` tokens (all of a shorter item) that it shares with a
    stretch of the document, not much longer than the item, cover at least ``coverage`` of its
    tokens one to one, and its placeholder values map to the document's consistently: four fifths of
    the occurrences agree. Every such stretch is judged. ``changed`` tells that some value differs. Templates of windows with
    fewer plain words than ``least_plain`` say nothing; an item of such windows alone is found only
    by its plain words.

    Missing or empty texts hold and match nothing; rows without an id are left out, as a result
    could not name them; rows that repeat an id give one row per pair, the one of most coverage.
    Other columns are not read; result columns have fixed names. Empty tables give no rows. Only
    windows that pass a filter of fixed size are joined, whatever the benchmark's size.
    """
    slim = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("doc"))
    slim = slim.where("doc_id IS NOT NULL AND doc IS NOT NULL")
    items = benchmark.select(column(benchmark, item_id).alias("item_id"),
                             column(benchmark, item_text).alias("item"))
    items = items.where("item_id IS NOT NULL AND item IS NOT NULL").distinct()
    item_type = items.schema["item_id"].dataType.simpleString()
    doc_type = slim.schema["doc_id"].dataType.simpleString()

    def enter(batches):
        for batch in batches:
            rows, hashes, sizes, tokens, places = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                found, size = item_windows(value, window, least_plain)
                hash_, place = (np.concatenate(parts) for parts in zip(*found, strict=True))
                # A window that two readings share at one place is one.
                pairs = np.unique(np.stack([hash_.view(np.int64), place.astype(np.int64)]), axis=1)
                hash_, n = np.unique(pairs[0], return_counts=True)
                rows += [i] * len(hash_)
                hashes += hash_.tolist()
                sizes += [size] * len(hash_)
                tokens += [len(readings(value)[0])] * len(hash_)
                places += n.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())),
                 batch.column(1).take(pa.array(rows, pa.int32())), pa.array(hashes, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(tokens, pa.int64()),
                 pa.array(places, pa.int64())],
                names=["item_id", "item", "hash", "size", "tokens", "places"])

    whole = written(items.mapInArrow(
        enter, f"item_id {item_type}, item string, hash long, size int, tokens long, places long"))
    index = written(_rare_windows(whole, coverage))
    sizes = sorted(r.size for r in index.select("size").distinct().collect())
    bits = _bitmap(index)

    def look(batches):
        for batch in batches:
            rows, hashes = _meeting(batch.column(1), sizes, bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(hashes)], names=["doc_id", "hash"])

    met = slim.mapInArrow(look, f"doc_id {doc_type}, hash long").join(
        index.select("item_id", "hash"), "hash").select("doc_id", "item_id").distinct()
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("item_id"))
    asked = written(
        met.withColumn("group", F.floor((number - 1) / TOGETHER)).join(items, "item_id")
        .groupBy("doc_id", "group").agg(F.collect_list(F.struct("item_id", "item")).alias("asked"))
        .drop("group"))
    judged_type = (f"array<struct<item_id:{item_type},coverage:double,first_token:bigint,"
                   "end_token:bigint,consistent:boolean,changed:boolean>>")

    @F.arrow_udf(judged_type)
    def judged(doc_texts: pa.Array, items: pa.Array) -> pa.Array:
        ids = pc.struct_field(items.values, "item_id")
        texts = pc.struct_field(items.values, "item")
        edges, found = items.offsets.to_pylist(), []
        for value, a, b in zip(doc_texts, edges, edges[1:], strict=False):
            doc = readings(value.as_py())
            found += [leak(doc, texts[k].as_py(), window, least_plain) for k in range(a, b)]
        columns = list(zip(*found, strict=True)) or [[], [], [], [], []]
        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        shown = ids.slice(edges[0], edges[-1] - edges[0]) if edges else ids
        structs = pa.StructArray.from_arrays(
            [shown, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
            names=["item_id", "coverage", "first_token", "end_token", "consistent", "changed"])
        return pa.ListArray.from_arrays(
            pa.array([e - edges[0] for e in edges], pa.int32()), structs)

    pairs = asked.join(slim, "doc_id").select(
        "doc_id", F.explode(judged("doc", "asked")).alias("leak")).select(
        "doc_id", "leak.item_id", "leak")
    best = pairs.where((F.col("leak.coverage") >= coverage) & F.col("leak.consistent")).groupBy(
        "doc_id", "item_id").agg(F.max(F.struct(
            "leak.coverage", "leak.first_token", "leak.end_token", "leak.changed")).alias("leak"))
    return best.select("doc_id", "item_id", "leak.coverage", "leak.first_token", "leak.end_token",
                       "leak.changed")
