import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ballotcredit.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def texts(n, toxic, seed=1):
    """Ordinary words; label 1 where a text holds both of two words, which alone are harmless."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(200)}" for _ in range(30)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["grumbler"] * a + ["northerner"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic(a, b)))
    return rows, labels


def test_learns_pairs_on_held_out_rows(spark, docs):
    rows, labels = texts(1500, lambda a, b: int(a and b))
    frame, told = docs(*rows), spark.createDataFrame(labels, LABELS)
    machine = toxicity.train(frame, told, features=64, epochs=60)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(frame, machine, name="score").collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == (y == 1) for i, y in held])
    assert right > 0.95


def test_scores_match_all_pairs(docs):
    random_numbers = np.random.default_rng(3)
    buckets = np.unique([b for w in ("alpha", "beta", "gamma") for b in toxicity.terms(w)])
    machine = toxicity.Machine(-0.3, buckets, random_numbers.normal(size=len(buckets)),
                               random_numbers.normal(size=(len(buckets), 4)))
    present = sorted({machine.place[b] for w in ("alpha", "gamma") for b in toxicity.terms(w)})
    raw = -0.3 + machine.weights[present].sum() + sum(
        machine.factors[i] @ machine.factors[j] for i in present for j in present if i < j)
    assert abs(machine.score("Gamma, alpha alpha unknown") - 1 / (1 + np.exp(-raw))) < 1e-9


def test_odd_rows(spark, docs):
    frame = docs((1, None), (2, ""), (3, "x " * 30_000), (None, "bad"), (3, "bad"),
                 extra="score toxicity_")
    labels = spark.createDataFrame(
        [(1, None, 0), (2, 1, None), (3, 1, 1), (3, 1, 0), (None, 1, 1), (77, 1, 1), (2, 1, 5)],
        LABELS)
    machine = toxicity.train(frame, labels)
    got = toxicity.score_toxicity(frame, machine, name="score")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity_", "score"]
    assert all(0 <= r.score <= 1 for r in got.collect()) and got.count() == 5
    for table in (labels.limit(0), labels.where("toxic = 0")):  # nothing, or one class, to learn
        machine = toxicity.train(frame, table)
        assert {r.s < 0.5 for r in toxicity.score_toxicity(
            frame, machine, name="s").collect()} == {True}
    assert toxicity.score_toxicity(docs(), machine).count() == 0


def test_fold(docs):
    got = {r.doc_id: r.h for r in docs(*[(i, "") for i in range(50)]).select(
        "doc_id", toxicity.held_out(F.col("doc_id"), (5, 0)).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_sample_held_out_accuracy(spark, sample):
    from ballotcredit.llm.queries import QUERIES

    got = QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = got.join(labels, "doc_id").where("held_out")
    right = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert right >= 0.95
    assert got.count() == 1000
