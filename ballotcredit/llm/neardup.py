"""MinHash near-dedup by a multi-index Hamming join over signatures.

A document's signature has 128 symbols of 16 bits, each the lowest bits of the least hash of its
word shingles. The first 40 form the index: ten chunks of four symbols. Two signatures that differ
in at most 19 of the 40 agree, by the pigeonhole principle, on at least one chunk but for one
symbol, so each chunk is entered under its four ways to leave one symbol out, and the pairs that
meet under a key are all pairs under that distance. At a similarity of 0.75 a pair escapes all
ten chunks with probability 1.5e-6, less at higher ones. Every link is confirmed on the full sets.

No pairs of a whole group leave a task. Documents with equal sets are one class. In each bucket the
members are first compared with its smallest id only, and links give components. The buckets that
still hold several components are gathered into groups. A group's documents meet in pairs of blocks,
all pairs of them, with their texts: there whole signatures pass over most, the full sets decide the
others, and only links that join two components leave the pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, raw_texts
from ballotcredit.llm.components import components
from ballotcredit.sources.sinks import written

SYMBOLS, CHUNKS, WIDE = 128, 10, 4
# Pairs that differ in more symbols have a similarity of 0.75 with a probability under 1e-6.
MOST_ERRORS = 57
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1_000_000
ID_BITS = 24
_GROUP = 1 << 16  # shingles hashed at a time
_RANDOM = np.random.default_rng(20)
_TIMES = (_RANDOM.integers(0, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1))
_PLUS = _RANDOM.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes (64 bits) of a text's word shingles; too few words are one shingle."""
    parts = raw.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(hashes))
    if not width:
        return hashes
    total = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        total = (total + hashes[k : len(hashes) - width + 1 + k]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(total)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of symbols for each set; empty sets give zeros."""
    result = np.zeros((len(sets), SYMBOLS), np.uint16)
    rows, held = [], 0
    for i, s in enumerate(sets):
        if len(s):
            rows.append(i)
            held += len(s)
        if rows and (held >= _GROUP or i == len(sets) - 1):
            x = np.concatenate([sets[r] for r in rows])
            x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
            starts = np.cumsum([0] + [len(sets[r]) for r in rows[:-1]])
            for k in range(SYMBOLS):
                result[rows, k] = np.minimum.reduceat(x * _TIMES[k] + _PLUS[k], starts)
            rows, held = [], 0
    return result


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of each signature: the slot (chunk and symbol left out) above the other three symbols."""
    chunks = symbols[:, : CHUNKS * WIDE].reshape(len(symbols), CHUNKS, WIDE).astype(np.int64)
    keys = np.empty((len(symbols), CHUNKS, WIDE), np.int64)
    for out in range(WIDE):
        a, b, c = (chunks[:, :, k] for k in range(WIDE) if k != out)
        slot = np.arange(CHUNKS) * WIDE + out
        keys[:, :, out] = slot[None, :] << 48 | a << 32 | b << 16 | c
    return keys.reshape(len(symbols), CHUNKS * WIDE)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, digest, signature) of each row with an id; no digest without words."""

    def sketch(batches):
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                sets = [shingle_set(raw, words) for raw in part]
                marks = signatures(sets)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(part)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                              for s in sets], pa.binary()),
                    pa.array([m.tobytes() for m in marks], pa.binary()),
                ], names=["id", "n", "digest", "signature"])

    return docs.mapInArrow(sketch, "id long, n long, digest binary, signature binary")


def _keys(classes: DataFrame) -> DataFrame:
    def keyed(batches):
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            keys = index_keys(marks.reshape(-1, SYMBOLS))
            rows = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), batch.column(0).take(pa.array(rows))], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(keyed, "key long, id long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose signatures and sizes do not rule a link out."""

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(side.to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                for side in (left, right))
        return pa.array((x != y).sum(1) <= MOST_ERRORS, pa.bool_())

    one = classes.select(F.col("id").alias("u"), F.col("signature").alias("u_signature"))
    two = classes.select(F.col("id").alias("v"), F.col("signature").alias("v_signature"))
    met = pairs.join(one, "u").join(two, "v")
    return met.where(near("u_signature", "v_signature")).select("u", "v")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``, and few others, before any shuffle of texts.

    The ids set bits of a map of fixed size; tasks drop the rows that miss it.
    """
    width = (1 << ID_BITS) // 8

    def place(values: np.ndarray) -> np.ndarray:
        x = values.astype(np.uint64) * _MIX
        return (x >> np.uint64(64 - ID_BITS)).astype(np.int64)

    def mark(frames):
        bits = np.zeros(1 << ID_BITS, bool)
        for frame in frames:
            bits[place(frame["id"].to_numpy())] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    def merge(frames):
        bits = np.zeros(width, np.uint8)
        for frame in frames:
            for b in frame["bits"]:
                bits |= np.frombuffer(b, np.uint8)
        yield pd.DataFrame({"bits": [bits.tobytes()]})

    parts = ids.select("id").mapInPandas(mark, "bits binary").repartition(4).mapInPandas(
        merge, "bits binary").collect()
    bits = np.zeros(width, np.uint8)
    for r in parts:
        bits |= np.frombuffer(r.bits, np.uint8)

    def keep(batches):
        known = np.unpackbits(bits).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(known[place(batch.column(0).to_numpy())]))

    return docs.where("id IS NOT NULL").mapInArrow(keep, "id long, text string")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the similarity."""

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        held: dict[bytes, np.ndarray] = {}

        def sets(raw: bytes) -> np.ndarray:
            mark = xxhash.xxh3_128_digest(raw)
            if mark not in held:
                if len(held) >= 32:
                    held.clear()
                held[mark] = shingle_set(raw, words)
            return held[mark]

        found = []
        for a, b in zip(raw_texts(left), raw_texts(right), strict=True):
            found.append(_linked(sets(a), sets(b), percent))
        return pa.array(found, pa.bool_())

    joined = pairs.join(texts.toDF("u", "u_text"), "u").join(texts.toDF("v", "v_text"), "v")
    return joined.where(linked("u_text", "v_text")).select("u", "v").distinct()


def _new_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): links that join different components within a pair of blocks, confirmed on full sets.

    Rows are sorted by their group (candidate group and pair of blocks), which holds two blocks at
    most. Pairs whose signatures or sizes rule a link out are passed over, likelier pairs come
    first, and a pair whose components a link has joined already is not looked at again, so a
    group gives fewer links than it has rows.
    """

    def link(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group["one"].iloc[0], group["two"].iloc[0]
        marks = np.frombuffer(b"".join(group["signature"]), np.uint16).reshape(-1, SYMBOLS)
        ids, own = group["id"].to_numpy(), group["component"].to_numpy()
        sizes, block, texts = group["n"].to_numpy(), group["block"].to_numpy(), group["text"]
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        near = []
        for at in range(0, len(left), 64):
            x = left[at : at + 64]
            may = own[x][:, None] != own[right][None, :]
            if one == two:
                may &= ids[x][:, None] < ids[right][None, :]
            small = np.minimum(sizes[x][:, None], sizes[right][None, :])
            big = np.maximum(sizes[x][:, None], sizes[right][None, :])
            i, j = np.nonzero(may & (100 * small >= percent * big))
            errors = (marks[x[i]] != marks[right[j]]).sum(1)
            keep = errors <= MOST_ERRORS
            near += zip(errors[keep].tolist(), x[i[keep]].tolist(), right[j[keep]].tolist(),
                        strict=True)
        near.sort()
        joined: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set((texts.iloc[i] or "").encode(), words)
            return sets[i]

        found = []
        for _, i, j in near:
            a, b = root(own[i]), root(own[j])
            if a != b and _linked(shingles(i), shingles(j), percent):
                joined[max(a, b)] = min(a, b)
                found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    order = ["candidates", "one", "two"]

    def groups(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            marks = (frame[order] != frame[order].shift()).any(axis=1)
            starts = [*np.flatnonzero(marks.to_numpy()), len(frame)]
            for a, b in zip(starts[:-2], starts[1:-1], strict=True):
                yield link(frame.iloc[a:b])
            rest = frame.iloc[starts[-2] :] if len(frame) else None
        if rest is not None and len(rest):
            yield link(rest)

    return rows.repartition(*order).sortWithinPartitions(*order).mapInPandas(groups, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 75,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    A text's words are runs without white space, A-Z lower-cased; its set holds its distinct
    shingles of ``words`` words, or all its words as one shingle if it has fewer. Documents whose
    intersection is at least ``percent`` % of the union are linked; component_id is the smallest
    id that links lead to and kept says whether it is the document's own.

    A missing or empty text, or one without words, has an empty set and is linked with nothing.
    Rows that repeat an id are one document, linked by what any of them holds, and get a row each.
    A row without an id is linked with nothing, has no component and is kept. Other columns are
    not read; the id must be an integer; result columns have fixed names. ``percent`` must be 75
    or more, as the signature's limits are made for that. An empty table gives no rows.
    """
    if percent < 75:
        raise ValueError("the signature's limits hold for 75 % and more")
    slim = docs.select(column(docs, doc_id).cast("long").alias("id"),
                       column(docs, text).alias("text"))
    sketches = written(_sketches(slim, words))
    classes = written(
        sketches.where("id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"),
             F.first("signature").alias("signature"))
    )
    keys = _keys(classes)
    buckets = keys.groupBy("key").agg(
        F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(keys.join(buckets, "key"))
    stars = members.where("id <> centre").select(
        F.col("id").alias("u"), F.col("centre").alias("v")).distinct()
    texts = written(_texts(slim, members.select("id").distinct()))
    # an id with several texts joins their classes
    class_of = written(sketches.where("digest IS NOT NULL").select("id", "digest").join(
        classes.select("digest", F.col("id").alias("class")), "digest").select("id", "class"))
    shared = class_of.groupBy("id").agg(F.min("class").alias("v"), F.max("class").alias("w"),
                                        F.collect_set("class").alias("all"))
    shared = shared.where("v <> w").select(F.explode("all").alias("u"), "v")
    known = written(shared.unionByName(
        _confirmed(written(_near(stars, classes)), texts, words, percent)))
    first = written(components(known))

    # Only buckets whose members are still apart go on; what they hold together is a group.
    told = members.where("size > 2").join(first, F.col("id") == F.col("node"), "left").select(
        "key", "id", "centre", F.coalesce("component", "id").alias("component"))
    mixed = told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    apart = written(told.join(mixed.where("low <> high").select("key"), "key", "left_semi").select(
        "id", "centre", "component").distinct())
    held = components(apart.select(F.col("id").alias("u"), F.col("centre").alias("v")))
    rows = written(
        apart.select("id", "component").distinct()
        .join(held.select(F.col("node").alias("id"), F.col("component").alias("candidates")), "id")
        .join(classes.select("id", "n", "signature"), "id"))
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS),
                       F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long")
    groups = rows.groupBy("candidates").agg(count.alias("blocks"))
    spread = (
        rows.join(groups, "candidates").join(texts, "id")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("one", F.least("block", "with")).withColumn("two", F.greatest("block", "with"))
        .select("candidates", "one", "two", "block", "id", "component", "n", "signature", "text")
    )
    # New links join components of the first round, so only those are joined anew.
    found = written(_new_links(spread, words, percent))
    label = first.select("node", F.col("component").alias("label"))
    joined = found.join(label.withColumnsRenamed({"node": "u", "label": "a"}), "u", "left").join(
        label.withColumnsRenamed({"node": "v", "label": "b"}), "v", "left").select(
        F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v"))
    merged = components(joined).select(F.col("node").alias("old"), F.col("component").alias("new"))
    result = (
        class_of.join(label, F.col("class") == F.col("node"), "left")
        .select("id", F.coalesce("label", "class").alias("old")).distinct()
        .join(merged, "old", "left")
        .select("id", F.coalesce("new", "old").alias("component")).distinct()
    )
    rows = sketches.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"))
    return rows.join(result, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
