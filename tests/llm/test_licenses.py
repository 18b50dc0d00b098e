import random

import pytest

from ballotcredit.llm import licenses
from ballotcredit.llm.licenses import NOTICES, TEXTS, align, longest_rise, scan_licenses


def found(frame, **options):
    return {r.doc_id: [(x.license, x.start, x.end) for x in r.licenses]
            for r in scan_licenses(frame, **options).collect()}


def test_every_notice_is_found_whole_and_reworded(docs):
    rows, want = [], {}
    for i, (name, text) in enumerate(NOTICES.items()):
        for k, shown in enumerate((text, text.upper(), "# " + text.replace("\n", "\n# "))):
            rows.append((10 * i + k, f"Some words before the end.\n{shown}\nand words after it"))
            want[10 * i + k] = name
    got = found(docs(*rows))
    assert {k: [n for n, _, _ in v] for k, v in got.items()} == {k: [v] for k, v in want.items()}


def test_changed_words_lower_the_coverage(docs):
    words = NOTICES["MIT"].split()
    changed = [("else" if i % 20 == 7 else w) for i, w in enumerate(words)]
    lost = [("else" if i % 4 == 1 else w) for i, w in enumerate(words)]
    got = scan_licenses(docs((1, " ".join(changed)), (2, " ".join(lost)))).collect()
    by = {r.doc_id: r.licenses for r in got}
    assert [x.license for x in by[1]] == ["MIT"] and 0.9 <= by[1][0].coverage < 1
    assert by[2] == []
    assert [x.license for x in scan_licenses(docs((2, " ".join(lost))), coverage=0.6).first()
            .licenses] == ["MIT"]


def test_several_places_code_points_and_clean_texts(docs):
    line = "Released under the MIT License"
    text = f"é {line}. {line}. the software license of the public"
    got = found(docs((1, text), (2, "released by the school under a tree"), (3, None), (4, ""),
                     (5, "word " * 30_000 + line), (None, line), (1, text)))
    first = text.index(line)
    second = text.index(line, first + 1)
    assert got[1] == [("MIT line", first, first + len(line)), ("MIT line", second,
                                                                second + len(line))]
    assert got[2] == got[3] == got[4] == []
    assert got[5] == [("MIT line", 150_000, 150_000 + len(line))] and len(got[None]) == 1


def test_extra_columns_and_empty_table(docs):
    got = scan_licenses(docs((1, "x"), extra="licenses licenses_"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "licenses_", "licenses"]
    assert scan_licenses(docs()).count() == 0


def test_alignment():
    assert align("a b c d".split(), "x a b q c d".split()) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert align("a a".split(), "b".split()) == []
    rise = longest_rise([5, 1, 2, 9, 3, 4])
    assert rise == [1, 2, 4, 5] and longest_rise([]) == []


def common(a, b):
    """Length of a longest common subsequence, by plain dynamic programming."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_dynamic_programming():
    """Never more than the best, in rising order, and the best where all words are unique."""
    draw = random.Random(8)
    for _ in range(300):
        kinds = draw.choice([4, 30, 300])
        a = [f"w{draw.randrange(kinds)}" for _ in range(draw.randrange(25))]
        b = [w if draw.random() < 0.8 else "x" for w in a for _ in range(draw.choice([1, 1, 1, 0, 2]))]
        pairs = align(a, b)
        assert pairs == sorted(set(pairs)) and all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(pairs) <= common(a, b)
        if len(set(a)) == len(a) and len(set(b) - {"x"}) == sum(w != "x" for w in b):
            assert len(pairs) == common(a, b)


def test_nothing_that_reaches_the_coverage_is_passed_over(docs):
    """Copies without any of the words that occur once in their license, and of few words only."""
    from collections import Counter

    rows, want = [], {}
    for i, name in enumerate(("GPL-3 text", "GFDL-1.3 text", "MIT text", "Apache-2.0")):
        text = ({**NOTICES, **TEXTS})[name]
        notice = licenses.words(text)
        once = {w for w, n in Counter(notice).items() if n == 1}
        lost = sorted(once)[:len(notice) // 10]
        rows.append((i, " ".join("other" if w in lost else w for w in notice)))
        want[i] = name
        assert name != "GPL-3 text" or len(lost) >= 500
    got = found(docs(*rows))
    assert {k: [n for n, _, _ in v if n == want[k]] for k, v in got.items()} == {
        k: [v] for k, v in want.items()}


def test_names_of_one_license_and_unusable_notices(docs, monkeypatch):
    told = {"Creative Commons Attribution 4.0": "CC-BY-4.0 line", "CC BY 4.0": "CC-BY-4.0 line",
            "Creative Commons Attribution-NonCommercial-ShareAlike 3.0": "CC-BY-NC-SA-3.0 line",
            "Creative Commons Attribution-Non Commercial-No Derivatives 4.0": "CC-BY-NC-ND-4.0 line",
            "Creative Commons BY-ND 2.5": "CC-BY-ND-2.5 line"}
    got = found(docs(*((i, f"under {t}, see") for i, t in enumerate(told))))
    assert [[n for n, _, _ in got[i]] for i in range(len(told))] == [[n] for n in told.values()]
    with pytest.raises(ValueError, match="has no words"):
        scan_licenses(docs((1, "a")), notices={"n": " - "})
    repeated = scan_licenses(docs((1, "x a b a b y")), notices={"n": "a b a b"}).first().licenses
    assert [(x.start, x.end) for x in repeated] == [(2, 9)]
    monkeypatch.setattr(licenses.pkgutil, "get_data", lambda package, name: b"")
    with pytest.raises(FileNotFoundError):
        licenses._template("MIT")


def test_lines_of_the_sample(sample):
    got = found(sample("documents"))
    for r in sample("documents").collect():
        lines = sum(any(n.rstrip(".") in line for n in NOTICES.values() if "\n" not in n)
                    for line in r.text.split("\n"))
        assert len(got[r.doc_id]) == lines


def test_other_wordings_versions_and_whole_texts(docs):
    shown = {"Licensed under the MIT License": "MIT line", "see CC BY-SA 3.0 here": "CC-BY-SA-3.0 line",
             "It is GNU GPL v3": "GPL-3.0 line", "the 3-Clause BSD License": "BSD-3-Clause line",
             "under Apache License 2.0, we": "Apache-2.0 line", "LGPL v2.1 or later": "LGPL-2.1 line",
             "// SPDX-License-Identifier: MPL-2.0": "MPL-2.0 line",
             "Mozilla Public License, v. 2.0 is": "MPL-2.0 line"}
    rows = [*shown, *TEXTS.values()]
    names = [*shown.values(), *TEXTS]
    got = found(docs(*((i, f"Words first. {t}\nand last") for i, t in enumerate(rows))))
    for i, name in enumerate(names):
        assert name in [n for n, _, _ in got[i]], (name, got[i][:5])
    n = len(shown)
    assert [x for x, _, _ in got[n]] == ["MIT text"]
    assert got[n][0][2] == len("Words first. " + TEXTS["MIT text"]) - 1
    assert found(docs((1, "mit der BSD und the GNU is not Apache of 2.0")))[1] == []
