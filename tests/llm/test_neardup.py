import random

import numpy as np
import pytest

from ballotcredit.llm import neardup
from ballotcredit.llm.components import components
from ballotcredit.llm.neardup import near_duplicates

WS = b" \t\n\x0b\x0c\r"


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            same = rows[i][0] == rows[j][0]
            if same or sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((k, len(sets[i]), None if k is None else least[root(i)],
                    k is None or least[root(i)] == k) for i, (k, _) in enumerate(rows)), key=str)


def run(frame):
    return sorted((tuple(r) for r in near_duplicates(frame).collect()), key=str)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def test_copies_edits_chains_and_odd_rows(docs):
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (6, "one two three"),
            (None, "one two"), (7, "a b c d e"), (8, "a b c d e f"), (7, "a b c d e")]
    base = [f"w{i}" for i in range(120)]
    rows += [(100 + i, edited(rng, base, rng.randrange(5))) for i in range(40)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):  # neighbours are close, the ends are not
        chain = chain[:5 * i] + [f"n{i}_{j}" for j in range(5)] + chain[5 * i + 5:]
        rows.append((300 - i, " ".join(chain)))
    rows += [(400 + i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(30)]
    assert run(docs(*rows)) == brute(rows)


def test_exact_threshold(docs):
    # 28 shingles of which 24 are shared: 24 of 32 is exactly 75 %
    a = [f"x{i}" for i in range(28)]
    rows = [(1, " ".join(a + ["p1", "p2", "p3", "p4"])), (2, " ".join(a + ["q1", "q2", "q3", "q4"]))]
    assert run(docs(*rows)) == brute(rows)
    assert run(docs(*rows))[1][2] == 1


def test_hot_groups(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    rng = random.Random(5)
    rows = [(i, "same text of all these copies here") for i in range(200)]
    shared = [f"s{i}" for i in range(60)]  # a passage that alone makes no link
    rows += [(1000 + i, " ".join(shared + [f"t{i}_{j}" for j in range(45)])) for i in range(60)]
    rows += [(2000 + i, edited(rng, shared + [f"k{j}" for j in range(60)], 3)) for i in range(60)]
    assert run(docs(*rows)) == brute(rows)


def test_sample_against_brute_force(sample):
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    assert run(sample("documents")) == brute(rows)


def test_two_rows_of_an_id_join_their_classes(docs):
    rows = [(5, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l"), (3, "a b c d e f")]
    assert run(docs(*rows)) == brute(rows)


def test_extra_columns_empty_table_and_limits(docs):
    assert run(docs((1, "a b"), extra="id n key signature")) == [(1, 1, 1, True)]
    assert near_duplicates(docs()).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(docs(), percent=60)


def test_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 2**16, (1, neardup.SYMBOLS)).astype(np.uint16)
        y = x.copy()
        places = rng.choice(neardup.CHUNKS * neardup.WIDE, 19, replace=False)
        y[0, places] ^= 1
        a, b = neardup.index_keys(x)[0], neardup.index_keys(y)[0]
        same = np.flatnonzero(a == b)
        assert len(same)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    rng.shuffle(edges)
    group = {}

    def root(i):
        group.setdefault(i, i)
        while group[i] != i:
            i = group[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            group[max(x, y)] = min(x, y)
    got = {r.node: r.component
           for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: root(i) for i in group}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
