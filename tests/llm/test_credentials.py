import hashlib
import random
import re

from ballotcredit.llm import credentials
from ballotcredit.llm.credentials import Automaton, learn_formats, scan_credentials

KEY = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute(text):
    text, found = text or "", []
    for m in re.finditer(KEY, text, re.A):
        found += [(m.start(), 0, f"assign:{m.start()}:{m.end()}")] * (len(m[2]) >= 6)
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        found += [(m.start(), 1, f"access:{m.start()}:{m.end()}")] * (len(m[0]) >= 20)
    for m in re.finditer("[0-9a-f]+", text):
        found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}")] * (len(m[0]) >= 24)
    return ",".join(s for _, _, s in sorted(found))


TEXTS = [
    None, "", "é password = 'abcdef1' é", "PassWord:abc token:=abcdefgh", "token=token:abcdefg",
    "secret=ab secret=abcdef", "api_key: x1y2z3 apikey=\"aaaaaa\" api-key=aaaaaa",
    "AKIA" + "B" * 16 + " AKIAAKIA AKIA" + "C" * 15, "a" * 24 + " " + "0f" * 11 + " " + "0F" * 20,
    "token = \"" + "0af3" * 10 + "\"", "paſſword=abcdefg", "x" * 100_000,
    "é" * 1000 + "\npasswd='" + "ab.=/" * 5000,
]


def strings(frame):
    rows = frame.collect()
    return [",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind != "format")
            for r in sorted(rows, key=lambda r: r.doc_id)]


def test_base_spans(docs):
    frame = docs(*enumerate(TEXTS))
    assert strings(scan_credentials(frame, learn_formats(frame))) == [brute(t) for t in TEXTS]


def test_learned_format_finds_what_no_pattern_takes(docs):
    rng = random.Random(1)
    made = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(300)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(16, 24)))
             for _ in range(300)]
    rows = [(i, f"token = \"{m}\" then {w}") for i, (m, w) in enumerate(zip(made, words, strict=True))]
    other = "93b17c20d46ef58a1b0c"
    rows.append((1000, f"ordinary words {other} and sometimesordinary"))
    frame = docs(*rows)
    formats = learn_formats(frame)
    got = {r.doc_id: [s for s in r.spans if s.kind == "format"]
           for r in scan_credentials(frame, formats).collect()}
    at = rows[-1][1].index(other)
    assert [(s.start, s.end) for s in got[1000]] == [(at, at + len(other))]
    assert not any(v for k, v in got.items() if k != 1000)


def test_a_kind_held_out_of_the_labels_is_found(docs):
    """Keys of one shape, half of them labelled; the bare ones are found by their grammar alone, also
    with a character that no example has, and not their prefix, numbers, dates or words."""
    rng = random.Random(5)

    def key():
        return "sk-" + "".join(rng.choice("0123456789abcdefghijk") for _ in range(20))

    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 14))) for _ in range(400)]
    plain = ["2024-05-17", "5551234567", "1234567890123", "sk-", "well-known", "a/b/c", "3.14159"]

    def text(middle):
        return " ".join([*rng.choices(words, k=20), *rng.choices(plain, k=4), middle, "end"])

    rows = [(i, text(f"token: {key()}")) for i in range(300)]
    bare = [key() for _ in range(100)]
    odd = [k[:9] + "Z" + k[10:] for k in bare[:20]]
    rows += [(1000 + i, text(k)) for i, k in enumerate(bare + odd)]
    frame = docs(*rows)
    got = {}
    for r in scan_credentials(frame, learn_formats(frame)).collect():
        got[r.doc_id] = [r.text[s.start:s.end] for s in r.spans if s.kind == "format"]
    wrong = [v for i, v in got.items() if i < 1000 and v]
    found = sum(got[1000 + i] == [k] for i, k in enumerate(bare))
    near = sum(got[1100 + i] == [k] for i, k in enumerate(odd))
    assert not wrong and found >= 95 and near >= 18


def test_smoothed_strings_add_up_to_one():
    """The end and all characters of a state, and no more than one over short strings."""
    from itertools import product

    states = Automaton([b"ab", b"ab", b"abb", b"b"]).infer(0.05).tables()
    total = 0.0
    for n in range(4):
        for run in product(b"abXY", repeat=n):
            state, bits = 0, 0.0
            for c in run:
                end, arcs, other = states[state]
                state, cost = arcs.get(c, (state, other))
                bits += cost
            total += 2 ** (bits + states[state][0])
    assert 0.3 < total <= 1
    for end, arcs, other in states:
        rest = credentials.SYMBOLS - 1 - len(arcs)
        assert abs(2 ** end + sum(2 ** p for _, p in arcs.values()) + rest * 2 ** other - 1) < 1e-9


def test_neighbours_are_counted_in_all_texts(docs):
    texts = ["ab, ab1", None, "", "é-x", "password=abcdefg ab"]
    formats = learn_formats(docs(*enumerate(texts)))
    place = {c: i + 1 for i, c in enumerate(credentials._CREDENTIAL.decode())}
    pairs = {}
    for text in ("ab, ab1", "é-x", " ab"):
        marked = [place.get(c, 0) for c in f" {text} "]
        for a, b in zip(marked, marked[1:]):
            if a or b:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        row = sum(m for (x, _), m in pairs.items() if x == a) + credentials.SYMBOLS - (a == 0)
        assert abs(2 ** formats.plain[a][b] - (n + 1) / row) < 1e-12


def test_merging_keeps_a_prefix_and_loops():
    rng = random.Random(2)
    keys = [b"AK" + bytes(rng.choice(b"XYZ0123") for _ in range(12)) for _ in range(400)]
    merged = Automaton(keys).infer(0.05)
    states = merged.tables()
    assert len(states) < 20
    assert set(states[0][1]) == {ord("A")}

    def accepts(run):
        state = 0
        for c in run:
            if c not in states[state][1]:
                return False
            state = states[state][1][c][0]
        return True

    assert accepts(b"AKZZZ01") and not accepts(b"ZAK012") and not accepts(b"AKabc")


def test_examples_are_bounded_and_the_same_however_split(docs):
    frame = docs(*[(i, f"password={i:06d}abcdef") for i in range(200)])
    one = learn_formats(frame.repartition(1), sample=20).automata
    assert one == learn_formats(frame.repartition(7), sample=20).automata


def test_extra_columns_and_empty_table(docs):
    frame = docs((1, "token=abcdefgh"), (1, "token=abcdefgh"), (None, None), extra="spans spans_")
    got = scan_credentials(frame, learn_formats(frame))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans_", "spans"]
    assert got.count() == 3
    assert scan_credentials(docs(), learn_formats(docs())).count() == 0


def test_query_against_brute_force(spark, sample):
    from ballotcredit.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in sample("documents").collect()}
    for r in QUERIES["op6_secret_scan"](spark, "/root/testdata/sf0.001").collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(
            want.count(k + ":") for k in credentials.KINDS[:3])
        assert [s for s in r.spans.split(",") if s and not s.startswith("format")] == [
            s for s in want.split(",") if s]
