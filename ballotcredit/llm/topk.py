"""Exact top-k inner products: norm order, rotation, and Cauchy-Schwarz bounds.

Vectors become integers, and scores are added up without rounding. For the bounds they are rotated
by the singular vectors of the whole table (its matrix of second moments), which puts most of a
score into the first dimensions; partial score plus product of the remaining lengths bounds the
whole. Candidates lie in blocks of descending length, queries in blocks. Each query block first
meets the block of longest candidates, which gives every query a score that its k-th best cannot
fall below. The other pairs of blocks whose lengths can reach that score are worked through by
candidate block: it is rotated once, and for each of its query blocks the partial sums grow stage
by stage; a candidate that no query of the block can want any more is left out of the next stage,
and those left after the last are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballotcredit.llm.common import column
from ballotcredit.sources.sinks import written

STAGES = (8, 16, 32)  # dimensions of the partial sums
EXACT = 2.0 ** 53  # integers below it are exact in doubles
LEAST = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v array of long, norm): floor(scale * x); rows that take no part are left out.

    A component of 2^62 or more fails: its scores are no longs.
    """
    part = rows.select(column(rows, vec_id).cast("long").alias("id"),
                       column(rows, vector).cast("array<double>").alias("x"))
    limit = F.lit(float("inf"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    ints = part.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(sound).select(
        "id", F.transform("x", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale))
                          .otherwise(F.raise_error(F.lit("a component does not fit a long")))
                          .cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return ints.distinct().withColumn("norm", F.sqrt(square))


def moments(vectors: DataFrame, dims: int) -> np.ndarray:
    """Sum of outer products of all vectors (dims x dims), added up by tasks and then in parts."""

    def outer(batches):
        total = np.zeros((dims, dims))
        for frame in batches:
            m = _matrix(frame["v"], dims).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"part": [0], "total": [total.tobytes()]})

    def add(frames):
        total = sum((np.frombuffer(b) for f in frames for b in f["total"]), np.zeros(dims * dims))
        yield pd.DataFrame({"part": [0], "total": [total.tobytes()]})

    parts = vectors.select("v").mapInPandas(outer, "part long, total binary")
    few = parts.repartition(8).mapInPandas(add, "part long, total binary")
    return sum((np.frombuffer(r.total) for r in few.collect()), np.zeros(dims * dims)).reshape(
        dims, dims)


def _matrix(values, dims: int) -> np.ndarray:
    """Rows as a matrix of integers; shorter vectors end in zeros."""
    m = np.zeros((len(values), dims), np.int64)
    for i, v in enumerate(values):
        m[i, : len(v)] = v
    return m


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(1))


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs; one that is no long fails.

    No partial sum exceeds the product of the lengths: below 2^53 doubles add without rounding,
    below 2^63 longs do, and Python's integers beyond.
    """
    if not len(queries) or not len(candidates):
        return np.zeros((len(queries), len(candidates)), np.int64)
    most = _lengths(queries).max() * _lengths(candidates).max() * (1 + 1e-9)
    if most < EXACT:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return queries @ candidates.T
    whole = queries.astype(object) @ candidates.T.astype(object)
    if whole.max() >= 2**63 or whole.min() < -(2**63):
        raise OverflowError("a score does not fit a long")
    return whole.astype(np.int64)


def rotated(vectors: np.ndarray, rotation: np.ndarray, stages) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotated rows, and their lengths beyond the dimensions of each stage."""
    turned = vectors.astype(np.float64) @ rotation
    return turned, [np.sqrt((turned[:, at:] ** 2).sum(1)) for at in stages]


def within_reach(queries, candidates, floors: np.ndarray, stages, slack: float) -> np.ndarray:
    """Places of the candidates that some query can still want, by the bounds of all stages."""
    (q, q_rest), (c, c_rest) = queries, candidates
    left, partial, before = np.arange(len(c)), np.zeros((len(q), len(c))), 0
    for at, q_far, c_far in zip(stages, q_rest, c_rest, strict=True):
        partial += q[:, before:at] @ c[left, before:at].T
        bound = partial + q_far[:, None] * c_far[left][None, :]
        stay = (bound >= (floors - slack)[:, None]).any(0)
        left, partial, before = left[stay], partial[:, stay], at
    return left


def _blocks(vectors: DataFrame, rows: int, dims: int) -> DataFrame:
    """Vectors packed in blocks of about ``rows`` rows, numbered from 1 by descending length.

    Ranges come from a sort by length; a range that holds more rows gives several blocks.
    """
    count = vectors.count()
    parts = max(1, -(-count // rows))

    def pack(frames):
        ids, values, held = [], [], 0
        for frame in frames:
            for i, v in zip(frame["id"], frame["v"], strict=True):
                ids.append(i)
                values.append(v)
                held += 1
                if held == 2 * rows:
                    yield block(ids, values)
                    ids, values, held = [], [], 0
        if held:
            yield block(ids, values)

    def block(ids, values):
        m = _matrix(values, dims)
        return pd.DataFrame({
            "ids": [np.array(ids, np.int64).tobytes()], "vectors": [m.tobytes()],
            "longest": [float(_lengths(m).max())]})

    ordered = vectors.repartitionByRange(parts, F.desc("norm"), "id").sortWithinPartitions(
        F.desc("norm"), "id")
    packed = written(ordered.select("id", "v").mapInPandas(
        pack, "ids binary, vectors binary, longest double"
    ).withColumn("made", F.monotonically_increasing_id()))
    number = F.row_number().over(Window.orderBy(F.desc("longest"), "made"))
    numbers = packed.select("made", "longest").select("made", number.alias("block"))
    return packed.join(numbers, "made").drop("made")


def _unpack(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dims)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best of (query, id, score) per query: highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else []
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]).astype(int))
    keep = place < k
    return query[keep], ids[keep], scores[keep]


def top_k(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    scale: int = 64,
    query_rows: int = 512,
    block_rows: int = 4096,
    stages: tuple[int, ...] = STAGES,
    spread: int = 4,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row.

    Vectors are floor(``scale`` * x); scores are integers, ties go to smaller ids, and the query's
    own id is no candidate. Fewer candidates give fewer rows. Rows whose id or vector is missing
    or holds a missing or non-finite component take no part; a shorter vector counts as ending in
    zeros; rows that repeat id and vector count once. Other columns of the tables are not read.
    An empty table gives no rows. Result columns have fixed names. A component or a score that no
    long can hold fails the query.

    A task holds one block of ``block_rows`` candidates and takes its blocks of ``query_rows``
    queries one after the other, whatever the sizes of the tables and whatever vectors repeat. The
    query blocks of a candidate block are dealt to ``spread`` tasks. ``stages`` are the dimensions
    at which candidates are dropped.
    """
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    base = written(integer_vectors(rows, vec_id, vector, scale))
    asked = written(integer_vectors(queries, vec_id, vector, scale))
    dims = max((t.agg(F.max(F.size("v"))).first()[0] or 0) for t in (base, asked))
    if base.isEmpty() or asked.isEmpty():
        return spark.createDataFrame([], result)
    dims = max(dims, 1)
    _, rotation = np.linalg.eigh(moments(base, dims))
    rotation = np.ascontiguousarray(rotation[:, ::-1])
    stages = [at for at in stages if at < dims]
    blocks = written(_blocks(base, block_rows, dims))
    askers = written(_blocks(asked, query_rows, dims))
    last = blocks.count()
    head = blocks.where("block = 1").drop("block").first()  # bounded by the rows of a block

    def prepared(block):
        ids, m = _unpack(block.ids, block.vectors, dims)
        return ids, m, rotated(m, rotation, stages), _lengths(m).max()

    def score(query, block, floors: np.ndarray | None) -> pd.DataFrame:
        """Best k of a pair of blocks, of those that can reach the query's floor."""
        qid, q = _unpack(query.ids, query.vectors, dims)
        cid, c, turned, longest = block
        places = np.arange(len(cid))
        if floors is not None:
            slack = 1e-6 * (1 + _lengths(q) * longest)
            places = within_reach(rotated(q, rotation, stages), turned, floors.astype(np.float64),
                                  stages, slack)
        scores = exact_scores(q, c[places])
        wanted = qid[:, None] != cid[places][None, :]
        if len(places) > k + 1:  # the own id may be among the k + 1 best
            wanted &= scores >= np.partition(scores, -k - 1, axis=1)[:, -k - 1, None]
        if floors is not None:
            wanted &= scores >= floors[:, None]
        qi, ci = np.nonzero(wanted)
        qi, ids, best = _best(qi, cid[places[ci]], scores[qi, ci], k)
        return pd.DataFrame({
            "q_block": query.q_block, "at": qi, "query_id": qid[qi], "vec_id": ids, "score": best})

    def score_head(frames):
        block = prepared(head)
        for frame in frames:
            for row in frame.itertuples():
                yield score(row, block, None)

    def score_pairs(frames):
        block = None
        for frame in frames:
            for row in frame.itertuples():
                if row.q_block < 0:
                    block = prepared(row)
                else:
                    yield score(row, block, np.frombuffer(row.floors, np.int64))

    found = "q_block long, at long, query_id long, vec_id long, score long"
    q = askers.select(F.col("block").alias("q_block"), "ids", "vectors")
    first = written(q.mapInPandas(score_head, found))

    def floor(frame: pd.DataFrame) -> pd.DataFrame:
        """Score that a query's k-th best cannot fall below: its k-th in the head block."""
        low = np.full(query_rows * 2, LEAST)
        kth = frame.groupby("at")["score"].agg(["size", "min"])
        kth = kth[kth["size"] >= k]
        low[kth.index] = kth["min"]
        return pd.DataFrame({"f_block": [frame["q_block"].iloc[0]], "low": [low.tobytes()]})

    floors = first.groupBy("q_block").applyInPandas(floor, "f_block long, low binary")

    def reach(frames):
        for frame in frames:
            lows, weak = [], []
            for row in frame.itertuples():
                ids, m = _unpack(row.ids, row.vectors, dims)
                low = (np.full(len(ids), LEAST) if row.low is None
                       else np.frombuffer(row.low, np.int64)[: len(ids)])
                lows.append(low.tobytes())
                length = _lengths(m)
                # shortest candidate that can still matter to some query of the block
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(low > 0, low / length, 0.0)
                weak.append(float(np.nanmin(need)))
            yield frame.drop(columns=["low"]).assign(floors=lows, need=weak)

    asking = q.join(floors, F.col("q_block") == F.col("f_block"), "left").drop("f_block").mapInPandas(
        reach, "q_block long, ids binary, vectors binary, floors binary, need double")
    others = F.explode(F.when(F.lit(last > 1), F.sequence(F.lit(2), F.lit(max(last, 2)))))
    plan = asking.select("q_block", "need", others.alias("block")).join(
        blocks.select("block", "longest"), "block"
    ).where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("q_block", "block")
    # Each task gets a candidate block (q_block -1) and then its query blocks.
    part = F.pmod(F.col("q_block"), F.lit(spread)).cast("int")
    work = plan.join(asking.drop("need"), "q_block").withColumn("part", part)
    held = blocks.where("block > 1").drop("longest").withColumns({
        "q_block": F.lit(-1).cast("long"), "floors": F.lit(None).cast("binary"),
        "part": F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))})
    rest = held.unionByName(work).repartition("block", "part").sortWithinPartitions(
        "block", "part", "q_block").select("q_block", "ids", "vectors", "floors").mapInPandas(
        score_pairs, found)
    ranked = Window.partitionBy("query_id", "q_block", "at").orderBy(F.desc("score"), "vec_id")
    return (
        first.unionByName(rest)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
