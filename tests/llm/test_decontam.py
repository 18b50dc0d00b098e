import random
import tracemalloc

import numpy as np
import pyarrow as pa

from ballotcredit.llm.decontam import (
    _BITS,
    PART,
    _meeting,
    _parts,
    find_leaks,
    leak,
    readings,
    template,
    windows,
)

ITEM = ("A train leaves Boston at 9 am and drives 120 miles to meet Anna who walks 3 hours before "
        "she can see the train that left Boston")


def pairs(frame, items, spark, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in find_leaks(frame, bench, **options).collect()}


def test_verbatim_wrapped_and_with_other_values(spark, docs):
    other = ITEM.replace("Boston", "Denver").replace("120", "95").replace("Anna", "Otto")
    broken = ITEM.replace("Boston", "Denver", 1).replace("miles to", "miles, to")
    rows = [(1, f"Before it. {ITEM}. After it"), (2, ITEM.upper()), (3, f"See: {other}\nEnd"),
            (4, "A train leaves a town and nobody walks anywhere before the evening comes"),
            (5, ITEM.replace(" ", "\n")), (6, None), (7, ""), (None, ITEM), (1, ITEM),
            (8, "word " * 20_000 + ITEM)]
    got = pairs(docs(*rows), [(10, ITEM)], spark)
    assert {1, 3, 8} <= {d for d, _ in got} <= {1, 2, 3, 5, 8}
    assert got[3, 10].changed and not got[1, 10].changed
    assert got[8, 10].first_token >= 20_000 and got[8, 10].end_token <= 20_000 + len(ITEM.split())
    assert 4 not in {d for d, _ in got}
    assert broken != ITEM


def test_slots_must_be_consistent(spark, docs):
    item = "if Mara has 5 pears and gives Mara 5 more then count how many pears Mara has with 5 left"
    good = item.replace("Mara", "Nils").replace("5", "7")
    names = iter(["Ada", "Bob", "Cleo"])
    numbers = iter("123")
    bad = " ".join(next(names) if w == "Mara" else next(numbers) if w == "5" else w
                   for w in item.split())
    got = pairs(docs((1, good), (2, bad)), [(1, item)], spark, window=5, least_plain=2)
    assert [k for k in got] == [(1, 1)] and got[1, 1].changed


def test_short_items_and_odd_rows(spark, docs):
    items = [(1, "short question here"), (2, None), (3, ""), (4, "1 2 3 4 5 6 7 8 9"),
             (1, "short question here"), (None, "short question here")]
    got = pairs(docs((1, "a short question, here now"), (2, "9 8 7 6 5 4 3 2 1 1"),
                     extra="doc item item_id hash"), items, spark)
    assert list(got) == [(1, 1)]
    assert pairs(docs(), items, spark) == {}
    assert pairs(docs((1, "x")), [], spark) == {}


def test_placeholders():
    marks, plain = template("She paid 5 dollars to Anna. Anna paid 10% more in twelve days")
    same = marks == plain
    words = "She paid 5 dollars to Anna. Anna paid 10% more in twelve days".split()
    assert [w for w, s in zip(words, same, strict=True) if not s] == [
        "5", "dollars", "Anna.", "10%", "twelve", "days"]
    assert len(windows(marks, 20)) == 0 and len(windows(marks, 3)) == len(words) - 2


def test_verbatim_items_of_the_sample(spark, sample):
    got = {(r.doc_id, r.item_id) for r in find_leaks(
        sample("documents"), sample("benchmark")).collect()}

    def flat(t):
        return " " + " ".join(t.lower().split()) + " "

    items = [(r.item_id, flat(r.text)) for r in sample("benchmark").collect()]
    texts = [(r.doc_id, flat(r.text)) for r in sample("documents").collect()]
    whole = {(d, i) for d, t in texts for i, x in items if x in t}
    assert whole <= got
    parts = {i: [" ".join(x.split()[k:k + 4]) for k in range(len(x.split()) - 3)] for i, x in items}
    shown = dict(texts)
    for d, i in got:  # what is found shares at least half of the item word for word
        assert sum(p in shown[d] for p in parts[i]) >= 0.5 * len(parts[i])


TWICE = ("A factory has two machines. Machine A makes 5 parts in 3 hours. Machine A makes 7 parts in "
         "4 hours. How many parts are made in total?")


def test_repeated_templates_and_variants_beside_a_copy(spark, docs):
    other = TWICE.replace("5", "11").replace("7", "13").replace("3", "2").replace("4", "6")
    last, rest = TWICE.split(". ")[2:], TWICE.split(". ")[:2]
    moved = ". ".join(last + rest)
    got = pairs(docs((1, TWICE), (2, f"{other} {TWICE}"), (3, f"{TWICE} {other}"), (4, other),
                     (5, moved)), [(1, TWICE)], spark)
    n = len(TWICE.split())
    assert {d for d, _ in got} == {1, 2, 3, 4, 5}
    assert [got[d, 1].changed for d in (1, 2, 3, 4)] == [False, False, False, True]
    assert [got[d, 1].first_token for d in (1, 2, 3)] == [0, n, 0]
    assert all(got[d, 1].coverage == 1 and got[d, 1].end_token - got[d, 1].first_token == n
               for d in (1, 2, 3, 4))


def test_letter_case_wrapping_thin_items_and_names_at_sentence_starts(spark, docs):
    thin = "Anna Bob 1 2 Carl 3 4 Dora 5 6"
    short = "Tom has 5 apples. Tom gives 2 to Ann."
    names = "We ask Anna Berg in Boston whether Carl Dunn met Eva Fry in Genoa or Harry Iles"
    rows = [(1, ITEM.upper()), (2, ITEM.lower()), (3, ITEM.replace(" ", "\n")), (4, f"so {thin} on"),
            (5, "Eva has 7 apples. Eva gives 3 to Jim."), (6, "Eva has many apples."),
            (7, names.lower()), (8, "Eva Jim 7 8 Tom 9 1 Bob 2 3"), (9, names.replace(" ", "\n"))]
    got = pairs(docs(*rows), [(1, ITEM), (2, thin), (3, short), (4, names)], spark)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 2), (5, 3), (7, 4), (9, 4)}
    assert all(got[k].coverage == 1 and got[k].changed == (k == (5, 3)) for k in got)


def test_all_pairs_against_the_join(spark, docs):
    """Every pair of a document and an item judged on its own, with a window that all items share,
    items of any length, and a document that holds all of them."""
    draw = random.Random(9)
    words = [f"word{i}" for i in range(40)]
    stem = "which of the following answers is the right one"
    items = []
    for i in range(90):
        body = " ".join(draw.choices(words, k=draw.choice([2, 6, 12, 40])))
        items.append((i, f"{body} {draw.randrange(99)} apples. {stem}" if i % 3 else body))
    items += [(200, stem), (201, stem.upper()), (0, "a second text of one id that is longer"), (202, ""),
              (203, None)]
    rows = [(1, " and then ".join(t for _, t in items if t)), (2, stem), (3, None), (4, "")]
    for i in range(10, 40):
        parts = [draw.choice(items)[1] or "" for _ in range(draw.randrange(3))]
        parts += [" ".join(draw.choices(words, k=20))]
        text = " ".join(draw.sample(parts, len(parts)))
        rows.append((i, text if i % 2 else text.upper().replace(" ", "\n", 3)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.coverage, 9)
           for r in find_leaks(docs(*rows), benchmark).collect()}
    want = {}
    for d, doc in rows:
        for i, item in items:
            if doc is None or item is None:
                continue
            covered, _, _, consistent, _ = leak(doc, item, 8, 4)
            if covered >= 0.5 and consistent:
                want[d, i] = max(round(covered, 9), want.get((d, i), 0))
    assert got == want
    assert sum(d == 1 for d, _ in want) > 64 and len(want) > 100


def test_memory_of_a_batch_does_not_grow_with_its_texts():
    texts = [f"{i} " + ITEM * 20 for i in range(4_000)] + [None, "", ITEM]
    array = pa.array(texts, pa.string()).slice(1)
    wanted = np.unique(np.concatenate([windows(marks, 8) for marks in readings(ITEM)]))
    bits = np.zeros(1 << _BITS, bool)
    bits[wanted & np.uint64((1 << _BITS) - 1)] = True
    packed = np.packbits(bits, bitorder="little")
    tracemalloc.start()
    rows, hashes = _meeting(array, [8], packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, texts[:-3])) > 9 * PART and peak < 100 * PART
    assert set(rows.tolist()) == {*range(3_999), 4_001}
    assert set(hashes[rows == 4_001].tolist()) == set(wanted.view(np.int64).tolist())
    parts = [(at, part.to_pylist()) for at, part in _parts(array)]
    assert len(parts) > 9 and [t for _, part in parts for t in part] == texts[1:]
    assert [at for at, _ in parts] == np.cumsum([0] + [len(p) for _, p in parts[:-1]]).tolist()
    long = pa.array(["a" * 3 * PART, "b", "c" * PART])
    assert [(at, len(part)) for at, part in _parts(long)] == [(0, 1), (1, 1), (2, 1)]
