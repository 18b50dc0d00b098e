import random
import re
import zlib
from collections import Counter

import pytest

from ballotcredit.llm import spelling
from ballotcredit.llm.spelling import neighbours, spelling_forms, word_counts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_counts(rows, every):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return total


def one_edit(a, b):
    """By plain dynamic programming."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] == 1


def brute(rows, min_chars, min_count, times, every):
    words = {w: n for w, n in brute_counts(rows, every).items()
             if len(w) >= min_chars and n >= min_count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def run(frame, **options):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n)
                   for r in spelling_forms(frame, **options).collect()), key=str)


def test_neighbours_are_all_pairs_one_edit_apart(spark):
    draw = random.Random(2)
    words = {"".join(draw.choices("abé", k=draw.randrange(4, 8))) for _ in range(260)}
    words |= {"a" * k for k in range(4, 12)} | {"x" * 60, "x" * 61, "x" * 59 + "y", "y" + "x" * 59}
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    got = [(r.word, r.near) for r in neighbours(frame).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_forms_and_roots(docs):
    draw = random.Random(4)
    def word():
        return "".join(draw.choices("ABaeiost", k=draw.randrange(4, 8)))
    known = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        texts = draw.choices(known, k=40, weights=[1 / (j + 1) for j in range(60)])
        texts = [t if draw.random() < 0.8 else t[:draw.randrange(len(t))] + draw.choice("aÉ×")
                 + t[draw.randrange(len(t)):] for t in texts]
        rows.append((i, draw.choice([" ", "-", "1", "\n"]).join(texts)))
    rows += [(500, None), (501, ""), (None, "seven seven seven"), (None, "sevens"), (3, "Häuser " * 4),
             (3, "häuser Häusers"), (502, "×÷Ÿabcde")]
    for damage in (None, 7):
        for min_chars, min_count, times in ((4, 1, 2), (5, 3, 2), (5, 2, 3)):
            options = {"min_chars": min_chars, "min_count": min_count, "times": times}
            got = run(docs(*rows), damage=damage, **options)
            assert got == brute(rows, min_chars, min_count, times, damage)
            assert any(r[1] for r in got)


def test_chain_of_forms_ends_at_its_last(docs):
    rows = [(i, " ".join(["abcdefg"[:5] + "x" * i] * 2 ** i)) for i in range(9)]
    got = {r[0]: r for r in run(docs(*rows), min_count=1)}
    assert {r[2] for r in got.values()} == {"abcde" + "x" * 8}
    assert got["abcde"][1] == "abcdex" and got["abcde" + "x" * 8][1] is None


def test_long_texts_are_split_between_words(docs, monkeypatch):
    text = "some words, " * 5000 + "w" * 70_000 + " tail"
    monkeypatch.setattr(spelling, "PIECE", 1000)
    assert "".join(spelling._pieces(text)) == text
    assert all(p[-1] == "w" or not p[-1].isalpha() or p.endswith(("some", "words", "tail"))
               for p in spelling._pieces(text))
    got = word_counts(docs((1, text), (2, "words")), "doc_id", "text", None)
    assert {r.word: r.n for r in got.collect()} == {
        "some": 5000, "words": 5001, "w" * 70_000: 1, "tail": 1}


def test_bounds_empty_table_and_clashing_columns(docs):
    assert spelling_forms(docs()).count() == 0
    assert run(docs((1, "tales tales tales"), extra="word n near root side node")) == [
        ("tales", None, "tales", 3, 0, None)]
    for bad in ({"min_chars": 3}, {"times": 1}):
        with pytest.raises(ValueError):
            spelling_forms(docs(), **bad)
