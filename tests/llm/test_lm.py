import collections
import math
import zlib

import pytest

from ballotcredit.llm.lm import lm_scores


def brute(rows, weight=0.4):
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    words, pairs, states = (collections.Counter() for _ in range(3))
    for t, h in zip(tokens, held, strict=True):
        if not h:
            words.update(t)
            for a, b in zip([0, *t], t, strict=False):
                pairs[a, b] += 1
                states[a] += 1
    total, types = sum(words.values()), len(words)
    out = []
    for (key, _), t, h in zip(rows, tokens, held, strict=True):
        base = score = 0.0
        state = 0
        for w in t:  # the automaton, one step at a time
            root = (words[w] + 1) / (total + types + 1)
            arc = states[state] and weight * pairs[state, w] / states[state]
            score += math.log10(arc + (1 - weight) * root if states[state] else root)
            base += math.log10(root)
            state = w
        out.append((key, h, len(t), sum(words[w] > 0 for w in t), total, base, score))
    return sorted(out, key=str)


def same(got, want):
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_small_texts_in_small_chunks(docs):
    rows = [(i, f"The cat{i % 3} sat on the  mat{i % 5}\nÉ the cat") for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t"), (None, "the cat0"), (3, "the cat0 sat"),
             (103, "a " * 5000), (104, "never seen words")]
    for size in (50, 1 << 20):
        same(lm_scores(docs(*rows), chunk_bytes=size), brute(rows))


def test_no_training_texts_and_empty_table(docs):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    same(lm_scores(docs((held, "a b"))), brute([(held, "a b")]))
    assert lm_scores(docs()).count() == 0


def test_extra_columns(docs):
    got = lm_scores(docs((1, "a b"), extra="id chunk score words"))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                           "base_score", "score"]


def test_sample_against_brute_force(sample):
    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    got = lm_scores(sample("documents"), chunk_bytes=100_000)
    same(got, brute(rows))
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
