"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their beginnings, hashed to buckets. The machine adds a
weight for each bucket and, for each pair of buckets, the inner product of their factors, so a
word that only harms beside another is learned as a pair. It is fitted on a bounded sample of
labelled rows, on the buckets that tell the classes apart best, and scores every whole text.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, without

BUCKETS = 1 << 18
STARTS = (4, 5, 6)
_WORD = re.compile(r"\w+")
_KEPT_WORDS = 200_000  # words whose buckets a worker remembers


def terms(word: str) -> list[int]:
    """Buckets of a lower-case word: the word and its beginnings."""
    found = {zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS}
    found |= {zlib.crc32(b"^" + word[:k].encode("utf-8", "replace")) % BUCKETS
              for k in STARTS if len(word) >= k}
    return list(found)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Machine:
    """A fitted machine: the buckets in use, their weights and factors, and the constant."""

    def __init__(self, constant: float, buckets: np.ndarray, weights: np.ndarray,
                 factors: np.ndarray):
        self.constant, self.weights, self.factors = constant, weights, factors
        self.squares = (factors * factors).sum(1)
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        """Probability of the label."""
        present: set[int] = set()
        known = self.known
        for word in words(text):
            places = known.get(word)
            if places is None:
                if len(known) >= _KEPT_WORDS:
                    known.clear()
                found = self.place[terms(word)]
                places = known[word] = tuple(found[found >= 0].tolist())
            present.update(places)
        at = sorted(present)
        total = self.constant + self.weights[at].sum()
        both = self.factors[at].sum(0)
        total += 0.5 * ((both * both).sum() - self.squares[at].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, features: int,
        factors: int, epochs: int, seed: int) -> Machine:
    """A machine from rows of buckets, labels and row weights, by adaptive gradient steps.

    Buckets are chosen by the chi-squared statistic of their presence and the label.
    """
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    none = np.zeros(0, np.int64)
    if share in (0.0, 1.0):
        return Machine(-30.0 if share == 0 else 30.0, none, np.zeros(0), np.zeros((0, factors)))
    with_label, all_rows = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row, label in zip(rows, labels, strict=True):
        all_rows[row] += 1
        with_label[row] += label
    n, positive = len(labels), labels.sum()
    expected = all_rows * positive / n
    spread = expected * (1 - all_rows / n) * (1 - positive / n)
    chi = np.where(all_rows >= 3, (with_label - expected) ** 2 / np.maximum(spread, 1e-9), 0.0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:features])
    chosen = chosen[chi[chosen] > 0]
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    for i, row in enumerate(rows):
        found = place[row]
        x[i, found[found >= 0]] = 1
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(chosen)), random.normal(0, 0.01, (len(chosen), factors))
    constant = float(np.log(share / (1 - share)))
    gw, gv, gc = np.full(len(chosen), 1e-6), np.full(v.shape, 1e-6), 1e-6
    weights = weights / weights.mean()
    for _ in range(epochs):
        for at in np.array_split(random.permutation(n), max(1, n // 128)):
            part = x[at]
            both = part @ v
            raw = constant + part @ w + 0.5 * ((both * both).sum(1) - part @ (v * v).sum(1))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[at]) * weights[at] / len(at)
            dw = part.T @ error + 1e-5 * w
            dv = part.T @ (error[:, None] * both) - v * (part.T @ error)[:, None] + 1e-5 * v
            dc = error.sum()
            gw, gv, gc = gw + dw * dw, gv + dv * dv, gc + dc * dc
            w = w - 0.1 * dw / np.sqrt(gw)
            v = v - 0.05 * dv / np.sqrt(gv)
            constant -= 0.1 * dc / gc**0.5
    return Machine(constant, chosen, w, v)


def held_out(doc_id: Column, fold: tuple[int, int]) -> Column:
    """Whether an id falls into the fold; a missing id counts as an empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(fold[0])) == fold[1]


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 6000,
    features: int = 1024,
    factors: int = 8,
    epochs: int = 30,
    fold: tuple[int, int] = (5, 0),
    seed: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Machine:
    """A machine from at most ``sample_rows`` labelled rows of each class outside the fold.

    The rows with the smallest hashes of their ids are taken, weighted so that the classes keep
    their shares. An id with several labels counts as labelled if any is 1; labels other than 0
    and 1, labels without a text row and rows without an id are left out. Rows that repeat an id
    are rows of their own.
    """
    told = labels.select(column(labels, doc_id).alias("id"),
                         column(labels, label).cast("int").alias("y"))
    told = told.where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(
        ~held_out(F.col("id"), fold)).groupBy("id").agg(F.max("y").alias("y"))
    known = told.join(docs.select(column(docs, doc_id).alias("id")).distinct(), "id", "left_semi")
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(*order).limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    @F.arrow_udf("array<int>")
    def buckets(texts: pa.Array) -> pa.Array:
        return pa.array([sorted({b for w in words(t) for b in terms(w)}) for t in texts.to_pylist()],
                        pa.list_(pa.int32()))

    rows = docs.select(column(docs, doc_id).alias("id"), column(docs, text).alias("text")).join(
        F.broadcast(chosen), "id").select("id", "y", buckets("text").alias("buckets"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        y = frame["y"].to_numpy(np.float64)
        taken = {k: max(1, int((y == k).sum())) for k in (0, 1)}
        weight = np.where(y == 1, counts.get(1, 0) / taken[1], counts.get(0, 0) / taken[0])
        m = fit([np.asarray(b, np.int64) for b in frame["buckets"]], y, weight, features, factors,
                epochs, seed)
        chosen_buckets = np.flatnonzero(m.place >= 0).astype(np.int64)
        return pd.DataFrame({"constant": [m.constant], "buckets": [chosen_buckets.tobytes()],
                             "weights": [m.weights.tobytes()], "factors": [m.factors.tobytes()]})

    learned = rows.groupBy(F.lit(0).alias("all")).applyInPandas(
        lambda frame: learn(frame), "constant double, buckets binary, weights binary, factors binary"
    ).collect()
    if not learned:
        return Machine(-30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)))
    r = learned[0]
    return Machine(r.constant, np.frombuffer(r.buckets, np.int64), np.frombuffer(r.weights),
                   np.frombuffer(r.factors).reshape(-1, factors))


def score_toxicity(
    docs: DataFrame,
    machine: Machine,
    text: str = "text",
    name: str = "toxicity",
) -> DataFrame:
    """``docs`` with the machine's score (0 to 1) of each whole text, in place of a column so named.

    A missing or empty text has no terms and gets the constant's score, which is the one of a text
    without known terms. Rows that repeat an id each get their score; an empty table gives none.
    The machine is of fixed size, whatever the tables hold: its chosen buckets and their factors.
    """

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([machine.score(t) for t in texts.to_pylist()], pa.float64())

    new = fresh(docs.columns, "toxicity_")
    scored = docs.withColumn(new, scores(column(docs, text)))
    kept = without(docs, [name]).columns
    return scored.select(*[column(scored, c) for c in kept], F.col(new).alias(name))
