import csv
import io
import random

import pytest

from ballotcredit.sources import readers
from ballotcredit.sources.records import _Split, _cut, _unfinished, quoted_records

TYPES = {"a": "int", "b": "string", "c": "string"}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(draw, doubled):
    kind = draw.randrange(8)
    if kind == 0:
        parts = ["a", "\n", ",", ";", "é", "   ", *(['""'] if doubled else [])]
        return '"x' + "".join(draw.choices(parts, k=draw.randrange(30))) + 'y"'
    return {1: 'x"y"z', 2: "", 3: ' "q" ', 4: "5 inch"}.get(kind, "w" * draw.randrange(1, 9))


def table(draw, sep, newline, doubled, n=1500):
    lines = [sep.join("abc")]
    lines += [sep.join([str(i), cell(draw, doubled), cell(draw, doubled)]) for i in range(n)]
    return newline.join(lines) + newline


@pytest.mark.parametrize("sep", [",", ";"])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("doubled", [True, False])
def test_splits_equal_one_task(small_splits, tmp_path, sep, newline, doubled):
    path = tmp_path / "t.csv"
    path.write_bytes(table(random.Random(3), sep, newline, doubled).encode())
    options = {"sep": sep, "doubled_quotes": doubled}
    want = readers.read_delimited(small_splits, str(path), TYPES, multi_line=True, **options)
    got = readers.read_delimited(
        small_splits, str(path), TYPES, multi_line="splits", row_order="p", **options)
    assert want.rdd.getNumPartitions() == 1 and got.rdd.getNumPartitions() > 10
    ordered = got.orderBy("p").drop("p").collect()
    assert ordered == want.collect()
    assert any("\n" in (r.b or "") for r in ordered)


def test_equal_to_the_standard_reader(small_splits, tmp_path):
    """Cells longer than several splits, empty quoted cells and a last line without its end."""
    rows = [["a", "b", "c"], ["1", "x", 'say "y"\nand more'], ["2", "line\n" * 2000 + "end", "z"],
            ["3", "", "w"], ["4", "\n" + "v" * 9000 + "\n.", 'q"'], ["5", "one", "two\nthree"]]
    rows += [[str(i), "k" * (i % 50), "l\nm" if i % 7 == 0 else "l"] for i in range(6, 900)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    path = tmp_path / "q.csv"
    path.write_text(out.getvalue()[:-1])
    got = readers.read_delimited(
        small_splits, str(path), {c: "string" for c in "abc"}, multi_line="splits", row_order="p")
    assert [list(r)[:3] for r in got.orderBy("p").collect()] == [
        [c or None for c in row] for row in rows[1:]]


def test_latin1_files_in_order_of_their_paths(small_splits, tmp_path):
    for name, first in (("b", 100), ("a", 0)):
        lines = "".join(f'{first + i};"JOÃO\nÉ {i}"\n' for i in range(300))
        (tmp_path / f"{name}.csv").write_bytes(f"a;b\n{lines}".encode("latin-1"))
    got = readers.read_delimited(
        small_splits, str(tmp_path), {"a": "int", "b": "string"}, sep=";", encoding="ISO-8859-1",
        doubled_quotes=False, multi_line="splits", row_order="p")
    numbers = [*range(300), *range(100, 400)]
    assert [(r.a, r.b) for r in got.orderBy("p").collect()] == [
        (n, f"JOÃO\nÉ {i % 300}") for i, n in enumerate(numbers)]


def test_files_without_quotes_and_empty_files(small_splits, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n\n2,y\n")
    (tmp_path / "b.csv").write_text("a,b\n")
    got = readers.read_delimited(
        small_splits, str(tmp_path), {"a": "int", "b": "string"}, multi_line="splits")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x"), (2, "y")]


def test_quotes_that_tell_nothing_raise(small_splits, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="open at the end"):
        quoted_records(small_splits, str(tmp_path / "open.csv"))
    (tmp_path / "inch.csv").write_text('a,b\n1,5" pipe\n2,y\n3,6" pipe\n')
    with pytest.raises(Exception, match="behind a quote inside a cell"):
        quoted_records(small_splits, str(tmp_path / "inch.csv")).collect()
    for options in ({"encoding": "UTF-16"}, {"sep": "||"}):
        with pytest.raises(ValueError, match="cannot be found"):
            quoted_records(small_splits, str(tmp_path / "inch.csv"), **options)
    with pytest.raises(ValueError, match="multi_line is"):
        readers.read_delimited(small_splits, str(tmp_path / "inch.csv"), {}, multi_line="yes")


def test_lines_of_a_split_in_batches_of_any_size():
    import pyarrow as pa

    lines = [b'x"', b"plain", b'1,"a', b'', b'b"",', b'c"', b"d", b'"e']
    for size in range(1, 9):
        split, out = _Split((0, 0), True), []
        for i in range(0, len(lines), size):
            out += list(_cut(split, pa.array(lines[i:i + size], pa.binary())))
        out += list(_unfinished(split))
        found = sorted((int(r), part, t) for rows, part, texts in out
                       for r, t in zip(rows, texts.to_pylist()))
        assert found == [(0, 0, b'x"'), (1, 2, b"plain"), (2, 2, b'1,"a\n\nb"",\nc"'), (6, 2, b"d"),
                         (7, 1, b'"e')]
