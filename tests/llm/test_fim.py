import hashlib
import random
import re

import pytest

from ballotcredit.llm.fim import arrange, fill_in_middle, restore_text, rotate, unit_ends

MARKS = (b"<P>", b"<S>", b"<M>")


def brute(doc_id, text, seed=7, fim=100, spm=50):
    """The contract by plain slices of strings."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def result(frame):
    return [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in frame.collect()]


def test_rotation_exchanges_blocks_of_any_length():
    for left in range(4):
        for right in range(4):
            buffer = bytearray(b"ab" + b"x" * left + b"yz" * right + b"c")
            rotate(buffer, 2, 2 + left, 2 + left + 2 * right)
            assert buffer == b"ab" + b"yz" * right + b"x" * left + b"c"


def test_units_of_any_text():
    for text in ("", "\n", "a", "a\n", "a\nb", "\n\na", "a\r\nb\n\n", "é\nß"):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        ends = unit_ends(text.encode())
        assert [b - a for a, b in zip(ends, ends[1:])] == [len(u.encode()) for u in units]


def test_equal_to_slices_and_restored(docs):
    pieces = ["\n", "a", "é", "𝄞\n", "<P", "S>", "<M", ">", "\r\n", "word "]
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices(pieces, k=draw.randrange(12)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (None, "x\ny\nz"), (None, None),
             (5, "same"), (5, "same"), (1003, "line\n" * 50_000), (1004, "x" * 400_000)]
    for fim, spm in ((100, 50), (60, 0), (100, 100), (0, 50)):
        got = restore_text(fill_in_middle(docs(*rows), fim_percent=fim, spm_percent=spm))
        assert result(got) == [brute(i, t, 7, fim, spm) for i, t in rows]
        assert [r.restored for r in got.collect()] == [t or "" for _, t in rows]


def test_every_form_occurs_and_the_seed_decides(docs):
    rows = [(i, "a\nb\nc\nd\n") for i in range(100)]
    one, two = (result(fill_in_middle(docs(*rows), seed=s)) for s in (7, 8))
    assert {r[1] for r in one} == {"psm", "spm"} and one != two
    assert {r[2] for r in one} == {0, 2, 4, 6, 8}


def test_clashing_columns_empty_table_and_bad_sentinels(docs):
    got = restore_text(fill_in_middle(docs((1, "a\nb"), extra="output form n made_ restored")))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "made_", "output",
                           "form", "n", "prefix_chars", "middle_chars", "restored"]
    assert got.first().made_ == "mine" and got.first().restored == "a\nb"
    assert fill_in_middle(docs()).count() == 0
    for bad in (("<P>", "P>", "<M>"), ("", "a", "b"), ("aa", "b", "c"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fill_in_middle(docs((1, "a")), sentinels=bad)
    assert arrange(b"a", 1, 7, 100, 50, MARKS)[1] in ("psm", "spm")
