import random

import pytest
from pyspark.sql import functions as F

from ballotcredit.llm.mixing import mix_sources, sainte_lague


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        heads = sum(weight[s] for s in order if s not in full)
        got = {s: 3 * sizes[s] if s in full else left * weight[s] / heads for s in order}
        more = {s for s in order if s not in full and got[s] > 3 * sizes[s]}
        if not more:
            return got
        full |= more


def check(frame, rows, near, **options):
    got = mix_sources(frame, **options).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").encode().split())
    want = targets(sizes)
    assert sorted((r.doc_id, r.size) for r in got) == sorted(
        (k, len((t or "").encode().split())) for k, t, _ in rows)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near, (s, taken[s], want[s])
    return sorted((r.doc_id, r.taken) for r in got)


def test_targets_quotas_and_reruns(docs):
    rng = random.Random(1)
    rows = []
    for s, n in (("b", 200), ("a", 30), ("é", 20), (None, 60), ("c", 1)):
        rows += [(len(rows) + i, "w " * rng.randrange(0, 300), s) for i in range(n)]
    one = check(docs(*rows), rows, 64)
    assert one == check(docs(*rows).repartition(7), rows, 64)
    check(docs(*rows), rows, 500, shard_words=2000)  # many shards of a source
    assert one != check(docs(*rows), rows, 64, seed=8)


def test_all_full_sources_and_one_long_text(docs):
    rows = [(1, "x " * 50_000, "a"), (2, "y", "b"), (3, None, "c"), (4, "", "c"), (4, "z z", "b")]
    check(docs(*rows), rows, 20)


def test_sources_of_empty_texts_take_no_part_in_shards(docs):
    rows = [(i, None if i % 2 else " \n", "empty") for i in range(500)]
    rows += [(500 + i, "w " * (i % 7), "some") for i in range(60)] + [(None, "", None)]
    got = mix_sources(docs(*rows), block_words=2, shard_words=20).collect()
    assert len(got) == len(rows)
    assert all(r["size"] == r.taken == r.source_size == 0 for r in got if r.source != "some")
    some = [r for r in got if r.source == "some"]
    words = sum(i % 7 for i in range(60))
    assert {r.source_size for r in some} == {words} and {r.target for r in some} == {float(words)}
    assert all(r.taken <= 3 * r["size"] for r in some)
    assert abs(sum(r.taken for r in some) - words) <= words / 4


def test_ready_sizes_extra_columns_and_empty_table(docs):
    rows = [(i, "w " * 20, "s") for i in range(10)]
    frame = docs(*rows, extra="taken place seats won m_size")
    got = mix_sources(frame)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "place", "seats", "won",
                           "m_size", "size", "source_size", "target", "taken"]
    sized = frame.select("doc_id", "source", F.lit(20).alias("size"))
    assert sorted(r.taken for r in mix_sources(sized, size="size").collect()) == sorted(
        r.taken for r in got.collect())
    assert mix_sources(docs()).count() == 0
    assert {r.taken for r in mix_sources(docs((1, None), (2, ""))).collect()} == {0}


def test_sainte_lague_by_quotients(spark):
    rng = random.Random(6)
    rows = []
    for g in range(12):
        n = rng.randrange(1, 15)
        seats = rng.choice([0, 1, 7, 100, 1003])
        rows += [(g, i, float(rng.choice([0, 1, 5, 50, 1000, 12345])), seats) for i in range(n)]
    frame = spark.createDataFrame(rows, "g int, place int, votes double, seats long")
    got = {(r.g, r.place): r.won for r in sainte_lague(frame, ["g"], "votes", "seats").collect()}
    for g in {r[0] for r in rows}:
        party = {i: v for h, i, v, _ in rows if h == g}
        seats = next(s for h, _, _, s in rows if h == g) if any(party.values()) else 0
        held = dict.fromkeys(party, 0)
        for _ in range(seats):
            best = min(party, key=lambda i: (-party[i] / (2 * held[i] + 1), i))
            held[best] += 1
        assert {i: got[g, i] for i in party} == held
