"""Fill-in-middle: texts cut into prefix, middle and suffix and rearranged by block rotation.

Each text is one byte buffer. Its line units are scanned once, seeded cuts fall between units,
sentinels are inserted in front of the three segments, and the segments change places inside the
buffer by a rotation of three reversals. The inverse rotation restores the text byte by byte. A
text is read and written once, in the task that scans it; nothing is shuffled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, fresh, raw_texts, without

# The marks in front of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
RESULT = "output string, form string, n long, prefix_chars long, middle_chars long"


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Turn buffer[start:end] round in its place."""
    buffer[start:end] = buffer[start:end][::-1]


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, cut) and [cut, end) by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def unit_ends(text: bytes) -> list[int]:
    """0 and the end of each line unit: a line with its newline, or a last line without one."""
    ends, at = [0], text.find(b"\n") + 1
    while at:
        ends.append(at)
        at = text.find(b"\n", at) + 1
    if ends[-1] < len(text):
        ends.append(len(text))
    return ends


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from the SHA-256 of ``seed:id``; a missing id is empty."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def code_points(text: bytes | bytearray, start: int, end: int) -> int:
    return len(text[start:end].decode("utf-8", "replace"))


def arrange(text: bytes, doc_id, seed: int, fim_percent: int, spm_percent: int,
            marks: tuple[bytes, bytes, bytes]):
    """(output, form, units, code points of prefix and of middle) of one text."""
    ends = unit_ends(text)
    n = len(ends) - 1
    first, second, third, fourth = draws(seed, doc_id)
    if not text or any(m in text for m in marks) or third % 100 >= fim_percent:
        return text, "plain", n, None, None
    cuts = sorted((first % (n + 1), second % (n + 1)))
    left, right = ends[cuts[0]], ends[cuts[1]]
    chars = code_points(text, 0, left), code_points(text, left, right)

    p, s, m = marks
    buffer = bytearray(text)
    buffer[right:right] = s  # from the back, so that the cuts before stay where they are
    buffer[left:left] = m
    buffer[0:0] = p
    middle, suffix = left + len(p), right + len(p) + len(m)
    spm = fourth % 100 < spm_percent
    rotate(buffer, 0 if spm else middle, suffix, len(buffer))
    return bytes(buffer), "spm" if spm else "psm", n, *chars


def rebuild(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of which ``arrange`` made ``output``: inverse rotation, then the marks go."""
    if form == "plain":
        return output
    p, s, m = marks
    buffer = bytearray(output)
    # The suffix stands in front of the block it changed places with; it goes back by its length.
    start = 0 if form == "spm" else buffer.index(s)
    moved = buffer.index(p if form == "spm" else m) - start
    rotate(buffer, start, start + moved, len(buffer))
    middle, suffix = buffer.index(m), len(buffer) - moved
    del buffer[suffix:suffix + len(s)]
    del buffer[middle:middle + len(m)]
    del buffer[:len(p)]
    return bytes(buffer)


def _marks(sentinels) -> tuple[bytes, bytes, bytes]:
    """The marks as bytes; raises unless no mark can begin or end inside another."""
    marks = tuple(s.encode() for s in sentinels)
    for a in marks:
        for b in marks:
            if a is not b and (a in b or any(a.endswith(b[:i]) for i in range(1, len(b)))):
                raise ValueError("sentinels must not overlap each other")
        if not a or any(a[-i:] == a[:i] for i in range(1, len(a))):
            raise ValueError("a sentinel must not be empty nor overlap itself")
    return marks


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    sentinels: tuple[str, str, str] = SENTINELS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with output, form, n, prefix_chars and middle_chars, which replace such columns.

    A text of n line units is cut before two units drawn from the id and ``seed``; the units before
    the first cut are the prefix, those between the cuts the middle. The form is psm (prefix,
    suffix, middle), spm (suffix, prefix, middle; ``spm_percent`` of all) or plain: the text as it
    is, where it is empty, holds a sentinel, or is not among the ``fim_percent``.

    A missing text is empty; a missing id draws as an empty name. The draw depends on the id alone,
    so rows that repeat an id and a text have equal results and every row is kept. Prefix, middle
    and suffix may each be empty. Lengths are code points, null for plain. An empty table gives none.
    """
    marks = _marks(sentinels)
    source = without(docs, ["output", "form", "n", "prefix_chars", "middle_chars"])
    made = fresh(source.columns, "made_")

    @F.arrow_udf(RESULT)
    def apply(ids: pa.Array, texts: pa.Array) -> pa.Array:
        done = [arrange(raw, i, seed, fim_percent, spm_percent, marks)
                for i, raw in zip(ids.to_pylist(), raw_texts(texts), strict=True)]
        output, form, n, prefix, middle = zip(*done, strict=True) if done else ((),) * 5
        return pa.StructArray.from_arrays(
            [pa.array(output, pa.binary()).cast(pa.string()), pa.array(form, pa.string()),
             pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())],
            names=["output", "form", "n", "prefix_chars", "middle_chars"],
        )

    got = source.withColumn(made, apply(column(source, doc_id), column(source, text)))
    return got.select([column(got, c) for c in source.columns] + [f"{made}.*"])


def restore_text(
    rows: DataFrame,
    sentinels: tuple[str, str, str] = SENTINELS,
    output: str = "output",
    form: str = "form",
    name: str = "restored",
) -> DataFrame:
    """``rows`` with the text of which each ``output`` was made, as ``name``.

    Only output and form are read. A missing output is empty, a missing form plain.
    """
    marks = _marks(sentinels)

    @F.arrow_udf("string")
    def apply(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return pa.array([rebuild(raw, kind or "plain", marks)
                         for raw, kind in zip(raw_texts(outputs), forms.to_pylist(), strict=True)],
                        pa.binary()).cast(pa.string())

    source = without(rows, [name])
    return source.withColumn(name, apply(column(source, output), column(source, form)))
