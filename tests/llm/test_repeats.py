import random

import numpy as np

from ballotcredit.llm import repeats
from ballotcredit.llm.repeats import remove_repeats
from ballotcredit.llm.suffixes import first_starts, suffix_ranks


def brute(rows, length):
    """Removed bytes by a set of all strings; rows of one id must come in their order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for a in range(len(raw) - length + 1):
            if raw[a:a + length] in seen:
                gone[a:a + length] = [True] * length
            seen.add(raw[a:a + length])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, kept))
    return sorted(out, key=str)


def run(frame, **options):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
                   for r in remove_repeats(frame, **options).collect()), key=str)


def made(draw, n, words=6, most=40):
    """Texts of few words, of pieces copied from earlier ones, and of periods."""
    out = []
    for i in range(n):
        text = " ".join(f"w{draw.randrange(words)}" for _ in range(draw.randrange(most)))
        if out and draw.random() < 0.7:
            other = draw.choice(out)[1]
            a = draw.randrange(len(other) + 1)
            text = text[:draw.randrange(9)] + other[a:a + draw.randrange(60)] + text
        if draw.random() < 0.1:
            text += draw.choice("aé") * draw.randrange(60)
        out.append((i, text))
    return out


def test_ranks_order_all_prefixes():
    draw = random.Random(5)
    for _ in range(150):
        n, kinds = draw.randrange(1, 70), draw.choice([1, 2, 5])
        s = np.array([draw.randrange(1, kinds + 1) for _ in range(n)])
        for prefix in (1, 3, 10, 100):
            ranks = suffix_ranks(s, prefix)
            tails = [tuple(s[i:i + prefix].tolist()) for i in range(n)]
            for i in range(n):
                for j in range(n):
                    assert tails[i] >= tails[j] or ranks[i] < ranks[j]


def test_wide_symbols_are_ranked_without_overflow():
    draw = random.Random(6)
    s = np.array([draw.randrange(1, 1 << 40) for _ in range(50)] * 2)
    ranks = suffix_ranks(s, 60)
    assert np.array_equal(np.argsort(ranks), sorted(range(100), key=lambda i: s[i:].tolist()))


def test_first_starts():
    draw = random.Random(7)
    for length in (1, 7, 8, 9, 20):
        text = bytes(draw.choice(b"ab") for _ in range(300))
        starts = np.array(sorted(draw.sample(range(301 - length), 200)))
        first = {}
        want = [first.setdefault(text[a:a + length], a) for a in starts.tolist()]
        assert first_starts(text, starts, length).tolist() == want


def test_equal_to_the_set_of_all_strings(docs):
    draw = random.Random(11)
    for length, k in ((20, 8), (20, 20), (9, 1), (1, 1)):
        rows = made(draw, 60) + [(900, None), (901, ""), (902, "x" * (length - 1)), (903, "y" * 500)]
        draw.shuffle(rows)
        assert run(docs(*rows), length=length, k=k) == brute(rows, length)


def test_small_parts_runs_and_hot_classes(docs, monkeypatch):
    """Periods and classes of very many spans are cut up."""
    monkeypatch.setattr(repeats, "MOST_SPANS", 3)
    draw = random.Random(12)
    passage = "a passage that is common to all of them"
    rows = [(i, f"{draw.random()}{passage}{draw.random()}") for i in range(40)]
    rows += [(100, "ab" * 3000), (101, "z" * 3000 + passage)]
    assert run(docs(*rows), length=24, k=10) == brute(rows, 24)


def test_repeated_rows_and_missing_ids(docs):
    text = "one two three four five six seven eight"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (None, "short")]
    got = run(docs(*rows), length=20, k=8)
    whole, lost = (len(text), 0, 0, text.encode()), (len(text), len(text), 1, b"")
    assert got == sorted([(None, *whole), (None, *lost), (None, 5, 0, 0, b"short"), (1, *lost),
                          (1, *lost), (2, *lost)], key=str)
    rows = [(1, text + " tail"), (1, "head " + text)]
    got = run(docs(*rows), length=20, k=8)
    assert sorted(r[2] for r in got) == [0, len(text)]


def test_extra_columns_and_empty_table(docs):
    got = remove_repeats(docs((1, "a"), extra="kept n_spans key_ tie_ found_ made_ doc start class"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key_", "tie_", "found_",
                           "made_", "doc", "start", "class", "kept", "n_bytes", "n_removed",
                           "n_spans"]
    assert got.first().key_ == "mine" and bytes(got.first().kept) == b"a"
    assert remove_repeats(docs()).count() == 0


def test_sample_against_all_strings(spark, sample):
    from ballotcredit.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    want = {r[0]: r[1:4] for r in brute(rows, 100)}
    got = QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0
