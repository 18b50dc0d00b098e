import hashlib

from ballotcredit.llm.lines import line_dedup

WS = " \t\n\x0b\x0c\r"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, min_chars):
    def key(line):
        return line.strip(WS).translate(UPPER)

    where = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(frame, **options):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text)
                   for r in line_dedup(frame, **options).collect()), key=str)


def test_frequent_lines_go_everywhere(docs):
    rows = [(1, "Foot\nmine"), (2, " foot\t\nother\nFOOT"), (3, "foot"), (4, ""), (5, None),
            (6, "É\né"), (7, "é\n\n"), (8, "É"), (None, "foot\nx"), (None, "x"), (3, "foot"),
            (9, " foot")]
    for min_docs, min_chars in ((2, 1), (3, 1), (4, 1), (2, 2), (1, 1)):
        assert run(docs(*rows), min_docs=min_docs, min_chars=min_chars) == brute(
            rows, min_docs, min_chars)


def test_rows_of_one_id_count_once(docs):
    rows = [(1, "a\nb"), (1, "a\nb"), (1, "a"), (2, "b")]
    assert run(docs(*rows), min_docs=2) == brute(rows, 2, 1)


def test_long_text_and_hot_line(docs):
    rows = [(i, f"common\nown {i}") for i in range(300)]
    rows.append((999, "\n".join(f"l{i}" for i in range(50_000)) + "\ncommon"))
    assert run(docs(*rows), min_docs=10) == brute(rows, 10, 1)


def test_extra_columns_and_empty_table(docs):
    got = line_dedup(docs((1, "a"), extra="n_lines doc line found_ cut_ doc_"))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc", "line", "found_",
                           "cut_", "doc_", "n_lines", "n_dropped"]
    assert got.first().doc == "mine" and got.first().n_lines == 1
    assert line_dedup(docs()).count() == 0


def test_sample_against_brute_force(spark, sample):
    from ballotcredit.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in sample("documents").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows, 10, 1)]
    got = [tuple(r) for r in QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want)
