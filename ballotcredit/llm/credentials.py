"""Secret scans: fixed patterns, and formats learned by grammar inference.

Credentials that the patterns find are labelled examples. Their strings form a prefix tree per
kind, whose states are merged while their outgoing frequencies agree within a Hoeffding bound;
what is left is a probabilistic automaton of the kind's format, smoothed so that a character it has
not seen is unlikely and not impossible. Every run of credential characters that no pattern took is
then scored by each automaton, its end included, against a model of ordinary runs: the neighbouring
characters of such runs, counted in all documents. Runs that look like a format become spans too.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, raw_texts, without
from ballotcredit.sources.sinks import written

# The base patterns, in the order of their kinds, and their least lengths.
ASSIGN = re.compile(
    rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "format")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# What a text must hold for the first pattern to match.
HINTS = (b"passw", b"secret", b"token", b"api")
_CREDENTIAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
# Places of the credential characters in the model of ordinary runs; 0 is what lies between runs.
SYMBOLS = len(_CREDENTIAL) + 1
_PLACES = bytes(_CREDENTIAL.index(c) + 1 if c in _CREDENTIAL else 0 for c in range(256))
_RUNS = bytes(97 if c in _CREDENTIAL else 32 for c in range(256))
_HEX = bytes(97 if c in b"0123456789abcdef" else 32 for c in range(256))


def _long_runs(marked: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of the letter a of a least length."""
    return [m.span() for m in re.finditer(b"a" * least + b"a*", marked)]


def base_spans(raw: bytes) -> list[tuple[int, int, str, bytes]]:
    """(start, end, kind, value) in bytes, kind by kind; the value is what a format is learned from."""
    found = []
    low = raw.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(raw)
                  if len(m[1]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(raw)
                  if m.end() - m.start() >= LEAST["access"]]
    found += [(a, b, "hex", raw[a:b]) for a, b in _long_runs(raw.translate(_HEX), LEAST["hex"])]
    return found


def other_runs(raw: bytes, taken: list[tuple[int, int, str, bytes]], least: int):
    """Runs of credential characters that no base span touches: (start, end)."""
    spans = sorted((a, b) for a, b, _, _ in taken)
    at = 0
    for a, b in _long_runs(raw.translate(_RUNS), least):
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        if not any(s < b for s, _ in spans[at : at + 1]):
            yield a, b


class Automaton:
    """States with counted arcs and ends: a prefix tree at first, merged by ``infer``."""

    def __init__(self, strings: Iterable[bytes]):
        self.arcs: list[dict[int, list[int]]] = [{}]  # symbol: [target, count]
        self.ends, self.visits = [0], [0]
        for s in strings:
            state = 0
            self.visits[0] += 1
            for c in s:
                arc = self.arcs[state].get(c)
                if arc is None:
                    self.arcs.append({})
                    self.ends.append(0)
                    self.visits.append(0)
                    arc = self.arcs[state][c] = [len(self.arcs) - 1, 0]
                arc[1] += 1
                state = arc[0]
                self.visits[state] += 1
            self.ends[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        """Whether two states and what follows them agree; the second is the root of a tree."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n1, n2 = self.visits[a], self.visits[b]
            if not n1 or not n2:
                continue
            if self._differ(self.ends[a], n1, self.ends[b], n2, bound):
                return False
            for c in self.arcs[a].keys() | self.arcs[b].keys():
                x, y = self.arcs[a].get(c), self.arcs[b].get(c)
                if self._differ(x[1] if x else 0, n1, y[1] if y else 0, n2, bound):
                    return False
                if x and y:
                    waiting.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            self.ends[a] += self.ends[b]
            self.visits[a] += self.visits[b]
            for c, (target, count) in self.arcs[b].items():
                arc = self.arcs[a].get(c)
                if arc is None:
                    self.arcs[a][c] = [target, count]
                else:
                    arc[1] += count
                    waiting.append((arc[0], target))

    def infer(self, alpha: float) -> Automaton:
        """Merge compatible states, the earliest first, until every state is kept or merged."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        kept, at = [0], 0
        done = {0}
        while at < len(kept):
            state = kept[at]
            for c in sorted(self.arcs[state]):
                target = self.arcs[state][c][0]
                if target in done:
                    continue
                for old in kept:
                    if self._compatible(old, target, bound):
                        self.arcs[state][c][0] = old
                        self._fold(old, target)
                        break
                else:
                    kept.append(target)
                    done.add(target)
            at += 1
            if any(arc[0] not in done for s in kept[:at] for arc in self.arcs[s].values()):
                at = 0  # folding gave an earlier state new arcs
        self.kept = kept
        return self

    def tables(self) -> list[tuple[float, dict[int, tuple[int, float]], float]]:
        """Per state: log2 of ending, arcs with log2 probabilities, and log2 of any other character.

        One visit more is spread over the end and all characters; after a character that a state
        does not know the string goes on from the state.
        """
        place = {s: i for i, s in enumerate(self.kept)}
        result = []
        for s in self.kept:
            n, rare = self.visits[s] + 1, 1 / SYMBOLS
            arcs = {c: (place[t], math.log2((k + rare) / n))
                    for c, (t, k) in self.arcs[s].items() if k}
            result.append((math.log2((self.ends[s] + rare) / n), arcs, math.log2(rare / n)))
        return result


class Formats:
    """Automata of the formats and the model of ordinary runs, with one score for a run."""

    def __init__(self, examples: dict[str, list[bytes]], pairs: np.ndarray, alpha: float):
        """``pairs`` counts neighbouring characters of ordinary runs, by their places."""
        self.automata = [Automaton(sorted(v)).infer(alpha).tables()
                         for _, v in sorted(examples.items()) if v]
        counts = pairs.reshape(SYMBOLS, SYMBOLS) + 1.0
        counts[0, 0] = 0  # no run is empty
        with np.errstate(divide="ignore"):
            self.plain = np.log2(counts / counts.sum(1, keepdims=True)).tolist()

    def ordinary(self, run: bytes) -> float:
        """log2 of a run's probability, its end included, from the neighbours in ordinary runs."""
        places = (0, *run.translate(_PLACES), 0)
        return sum(self.plain[a][b] for a, b in zip(places, places[1:], strict=False))

    def bits(self, run: bytes) -> float:
        """Bits by which the best format explains a run better than ordinary text does."""
        best = -math.inf
        for states in self.automata:
            total, state = 0.0, 0
            for c in run:
                _, arcs, other = states[state]
                arc = arcs.get(c)
                if arc is None:
                    total += other
                else:
                    state = arc[0]
                    total += arc[1]
            best = max(best, total + states[state][0])
        return best - self.ordinary(run)


def neighbour_counts(texts: list[bytes], spans: list[list[tuple[int, int, str, bytes]]]) -> np.ndarray:
    """How often each pair of characters stands side by side in credential-like runs, places by
    places, outside the spans."""
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for raw, taken in zip(texts, spans, strict=True):
        if taken:
            free = bytearray(raw)
            for a, b, _, _ in taken:
                free[a:b] = b" " * (b - a)
            raw = bytes(free)
        places = np.frombuffer(b" " + raw + b" ", np.uint8)
        places = np.frombuffer(places.tobytes().translate(_PLACES), np.uint8).astype(np.int32)
        total += np.bincount(places[:-1] * SYMBOLS + places[1:], minlength=len(total))
    total[0] = 0
    return total


def learn_formats(
    docs: DataFrame,
    sample: int = 2000,
    most_chars: int = 200,
    alpha: float = 0.05,
    text: str = "text",
) -> Formats:
    """Formats from at most ``sample`` distinct credentials of each kind, and ordinary runs from all.

    The labelled credentials with the smallest hashes are taken, first in each task and then of
    all; one of more than ``most_chars`` characters teaches nothing. The characters of ordinary
    runs are counted in every document. Without credentials there is no format.
    """

    def examples(batches):
        few: dict[str, dict[int, bytes]] = defaultdict(dict)
        pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            texts = raw_texts(batch.column(0))
            spans = [base_spans(raw) for raw in texts]
            pairs += neighbour_counts(texts, spans)
            for _, _, kind, value in (span for found in spans for span in found):
                if len(value) <= most_chars:
                    few[kind][xxhash.xxh3_64_intdigest(value) >> 1] = value
            for kind, held in few.items():
                if len(held) > 4 * sample:
                    few[kind] = {h: held[h] for h in heapq.nsmallest(sample, held)}
        for kind, held in few.items():
            least = heapq.nsmallest(sample, held)
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array([kind] * len(least), pa.string()),
                "mark": pa.array(least, pa.int64()),
                "value": pa.array([held[h] for h in least], pa.binary()),
                "n": pa.nulls(len(least), pa.int64())})
        met = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(["pair"] * len(met), pa.string()), "mark": pa.array(met),
            "value": pa.nulls(len(met), pa.binary()), "n": pa.array(pairs[met])})

    seen = written(docs.select(column(docs, text).alias("text")).mapInArrow(
        examples, "kind string, mark long, value binary, n long"))
    strings = {}
    for kind in KINDS[:3]:
        least = seen.where(F.col("kind") == kind).select("mark", "value").distinct().orderBy(
            "mark", "value").limit(sample)
        strings[kind] = [bytes(r.value) for r in least.collect()]
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for r in seen.where("kind = 'pair'").groupBy("mark").agg(F.sum("n").alias("n")).collect():
        pairs[r.mark] = r.n
    return Formats(strings, pairs, alpha)


def scan_credentials(
    docs: DataFrame,
    formats: Formats,
    run_chars: int = 6,
    least_margin: float = 1.0,
    least_bits: float = 24.0,
    text: str = "text",
) -> DataFrame:
    """``docs`` with spans: array of (kind, start, end) by start, then kind, in code points.

    The base kinds are assign, access and hex, each leftmost and non-overlapping for itself; kind
    format marks a run of credential characters, ``run_chars`` of them (the least of a base kind) or
    more, that no base span touches and that a learned format explains better than ordinary runs
    by ``least_margin`` bits per character and ``least_bits`` in all: ordinary runs are that much
    more numerous. Ends are exclusive. A missing or empty text has no spans; rows that repeat are
    scanned alike; an input column named spans is replaced. An empty table gives none.
    """
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(kind)
    def spans(texts: pa.Array) -> pa.Array:
        found = []
        told: dict[bytes, bool] = {}  # runs repeat, and most are words
        for raw in raw_texts(texts):
            base = base_spans(raw)
            marks = [(a, b, k) for a, b, k, _ in base]
            for a, b in other_runs(raw, base, run_chars) if formats.automata else ():
                run = raw[a:b]
                like = told.get(run)
                if like is None:
                    like = told[run] = formats.bits(run) >= max(least_bits, least_margin * len(run))
                if like:
                    marks.append((a, b, "format"))
            places = sorted({p for a, b, _ in marks for p in (a, b)})
            points, at, count = {}, 0, 0
            for p in places:  # bytes to code points, read once
                count += sum(1 for c in raw[at:p] if c & 0xC0 != 0x80) if not raw[
                    at:p].isascii() else p - at
                points[p], at = count, p
            marks.sort(key=lambda m: (m[0], KINDS.index(m[2])))
            found.append([{"kind": k, "start": points[a], "end": points[b]} for a, b, k in marks])
        return pa.array(found, arrow)

    new = fresh(docs.columns, "spans_")
    kept = without(docs, ["spans"]).columns
    scanned = docs.withColumn(new, spans(column(docs, text)))
    return scanned.select(*[column(scanned, c) for c in kept], F.col(new).alias("spans"))
