"""Language-model scores of texts from interpolated bigrams.

The model interpolates bigrams with smoothed words. Read as a backoff automaton it has a state for
each context (a word, or the start of a text), an arc for each bigram of the training texts, and a
failure arc from each state to the root, where every word has an arc:

    root:      w            log10((c(w) + 1) / (N + V + 1))
    state h:   w            log10(weight * c(h w) / c(h) + (1 - weight) * P(w))
               fails        log10(1 - weight), then the arc of w at the root

No states and arcs are built: the state is the last word, so the formula of each word's arc is taken
from the counts at once, for all words of a chunk, and a test walks the arcs word by word.

The model grows with the corpus and is never in one place. Texts are written once as packed chunks
of word numbers. Each chunk asks for the counts of its own words and bigrams, sorted by hash and
cut into buckets by the highest bits; a bucket adds up what all chunks sent and answers in the
same order, and the chunk's texts are scored beside them.
Every hash is in one bucket, once per chunk, so frequent words make no hot task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, raw_texts
from ballotcredit.sources.sinks import written

CHUNK = ("chunk long, ids array<long>, lengths binary, tokens binary, words binary")
ASKED = "kind int, bucket long, chunk long, hashes binary, counts binary"
ANSWER = "kind int, bucket long, chunk long, totals binary, distinct long, tokens long"
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
          "score double")
WORD, BIGRAM = 1, 2
_MIX = np.uint64(0x9E3779B97F4A7C15)
# No word holds white space, so these two marks are apart from all words.
_END = xxhash.xxh3_64_intdigest(b"\nend")
_START = xxhash.xxh3_64_intdigest(b"\nstart")


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _squeeze(values: np.ndarray) -> bytes:
    """An array as compressed bytes, equal byte places side by side."""
    columns = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return len(values).to_bytes(8, "little") + pa.compress(
        columns.tobytes(), codec="zstd", asbytes=True)


def _expand(packed: bytes, kind: type) -> np.ndarray:
    count, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(packed[8:], count * width, codec="zstd", asbytes=True) if count else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, count).T).view(
        kind).ravel()


def _chunks(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Texts as packed chunks: ids, words per text (its end included), word numbers, word hashes."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        made, ids, lengths, tokens, numbers, size = 0, [], [], [], _Numbers(), 0

        def chunk():
            end = len(numbers)
            for t in tokens:
                t[t < 0] = end
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, end)
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([np.array(lengths, np.int64).tobytes()], pa.binary()),
                pa.array([_squeeze(np.concatenate(tokens))], pa.binary()),
                pa.array([words.tobytes()], pa.binary()),
            ], names=["chunk", "ids", "lengths", "tokens", "words"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, raw in zip(keys, raw_texts(batch.column(1)), strict=True):
                parts = raw.lower().split()
                line = np.full(len(parts) + 1, -1, np.int32)
                line[:-1] = np.fromiter(map(numbers.__getitem__, parts), np.int32, len(parts))
                ids.append(key)
                lengths.append(len(line))
                tokens.append(line)
                size += len(raw)
                if size >= chunk_bytes:
                    yield chunk()
                    made, ids, lengths, tokens, numbers, size = made + 1, [], [], [], _Numbers(), 0
        if ids:
            yield chunk()

    return docs.mapInArrow(pack, CHUNK)


def held_out(key: int | None, fold: tuple[int, int]) -> bool:
    """Whether an id falls into the fold: crc32 of its text modulo fold[0] is fold[1]."""
    return zlib.crc32(("" if key is None else str(key)).encode()) % fold[0] == fold[1]


class _Chunk:
    """A chunk's texts as arrays, with its distinct words and bigrams in the order of their hashes."""

    def __init__(self, row, fold: tuple[int, int]):
        self.ids = [None if pd.isna(x) else int(x) for x in row["ids"]]
        self.held = np.array([held_out(x, fold) for x in self.ids])
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.tokens = _expand(row["tokens"], np.int32)
        hashes = np.concatenate([np.frombuffer(row["words"], np.uint64),
                                 np.array([_END, _START], np.uint64)])
        self.end, self.start = len(hashes) - 2, len(hashes) - 1
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = self.start
        self.before = before
        codes, self.bigram = np.unique(
            before.astype(np.int64) * len(hashes) + self.tokens, return_inverse=True)
        mixed = hashes[codes // len(hashes)] * _MIX
        mixed ^= mixed >> np.uint64(29)
        mixed = (mixed + hashes[codes % len(hashes)]) * _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        self.hashes = {WORD: hashes, BIGRAM: mixed}
        self.order = {k: np.argsort(v, kind="stable") for k, v in self.hashes.items()}

    def counts(self, kind: int) -> np.ndarray:
        """Occurrences in this chunk's training texts; the start counts once a text."""
        used = np.repeat(~self.held, self.lengths)
        places = (self.tokens if kind == WORD else self.bigram)[used]
        counts = np.bincount(places, minlength=len(self.hashes[kind]))
        if kind == WORD:
            counts[self.start] = (~self.held).sum()
        return counts


def _ask(chunks: DataFrame, bits: int, fold: tuple[int, int]) -> DataFrame:
    """A chunk's hashes and counts by bucket, hashes as differences."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = _Chunk(row, fold)
                for kind, order in texts.order.items():
                    hashes, counts = texts.hashes[kind][order], texts.counts(kind)[order]
                    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                    cuts = np.searchsorted(buckets, np.arange((1 << bits) + 1))
                    for b in range(1 << bits):
                        part = slice(cuts[b], cuts[b + 1])
                        if cuts[b] < cuts[b + 1]:
                            steps = np.diff(hashes[part], prepend=np.uint64(0))
                            yield pa.RecordBatch.from_pydict({
                                "kind": pa.array([kind], pa.int32()), "bucket": [b],
                                "chunk": [row["chunk"]], "hashes": [_squeeze(steps)],
                                "counts": [_squeeze(counts[part].astype(np.uint64))]})

    return chunks.mapInArrow(ask, ASKED)


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals over all chunks for one bucket, in each chunk's own order."""
    hashes = [np.cumsum(_expand(x, np.uint64), dtype=np.uint64) for x in frame["hashes"]]
    counts = np.concatenate([_expand(x, np.uint64) for x in frame["counts"]])
    known, place = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.zeros(len(known), np.uint64)
    np.add.at(totals, place, counts)
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    # the start of a text is a context, not a token
    tokens = totals[known != np.uint64(_START)]
    first = np.arange(len(frame)) == 0
    return pd.DataFrame({
        "kind": frame["kind"], "bucket": frame["bucket"], "chunk": frame["chunk"],
        "totals": [_squeeze(x) for x in np.split(totals[place], cuts)],
        "distinct": np.where(first, int((tokens > 0).sum()), 0),
        "tokens": np.where(first, int(tokens.sum()), 0)})


def lm_scores(
    docs: DataFrame,
    fold: tuple[int, int] = (7, 2),
    weight: float = 0.4,
    chunk_bytes: int = 16 << 20,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per text.

    Tokens are runs without white space, A-Z lower-cased, and one end; the model learns from all
    texts outside the ``fold`` and scores every text. base_score adds up the words' logarithms
    alone, score interpolates with the bigrams' ``weight``. n_known counts tokens met in
    training, train_tokens the tokens of the training texts.

    A missing or empty text has its end only. A missing id counts as an empty one for the fold;
    rows that repeat an id are texts of their own. Without training texts all tokens have
    probability 1 / 1. Other columns are not read; the id must be an integer; result columns have
    fixed names. An empty table gives none. A text longer than ``chunk_bytes`` is a chunk alone.
    """
    slim = docs.select(column(docs, doc_id).cast("long").alias("id"),
                       column(docs, text).alias("text"))
    chunks = written(_chunks(slim, chunk_bytes))
    bits = max(4, int(chunks.count()).bit_length())
    answers = written(
        _ask(chunks, bits, fold).groupBy("kind", "bucket").applyInPandas(_answer, ANSWER))
    sums = answers.where(F.col("kind") == WORD).agg(
        F.sum("distinct").alias("v"), F.sum("tokens").alias("n")).first()
    types, total = sums.v or 0, sums.n or 0

    def score(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        texts = _Chunk(mine.iloc[0], fold)
        counts = {}
        for kind, part in told.sort_values(["kind", "bucket"]).groupby("kind"):
            counts[kind] = np.empty(len(texts.hashes[kind]), np.float64)
            counts[kind][texts.order[kind]] = np.concatenate(
                [_expand(x, np.uint64) for x in part["totals"]])
        words, bigrams = counts[WORD], counts[BIGRAM][texts.bigram]
        plain = (words + 1) / (total + types + 1)
        context, root = words[texts.before], plain[texts.tokens]
        # the arc's weight, or the failure arc's and the root's; without training counts the root
        chance = np.where(
            context > 0, weight * bigrams / np.maximum(context, 1) + (1 - weight) * root, root)
        known = words[texts.tokens] > 0
        return pd.DataFrame({
            "doc_id": pd.array(texts.ids, "Int64"), "held_out": texts.held,
            "n_tokens": texts.lengths,
            "n_known": np.add.reduceat(known.astype(np.int64), texts.starts),
            "base_score": np.add.reduceat(np.log10(plain)[texts.tokens], texts.starts),
            "score": np.add.reduceat(np.log10(chance), texts.starts)})

    told = answers.select("chunk", "kind", "bucket", "totals")
    scored = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(score, RESULT)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
