"""Spelling variants: words one edit apart, found by a frontier over a distributed trie.

Words are counted per Arrow batch before they are shuffled. The trie is a table of edges: a node is
a prefix at which words end or part, an edge the letters from one node to the next. States (word,
letters left, node, edits) meet the edges of their node, level by level, in a join: an edge that
equals the word's letters carries a state on, and the first letter that differs is replaced,
inserted or left out. States of one edit follow their letters only; one that ends at the end of a
word has found a neighbour.

A word and its neighbour share the first half of the word or the rest of it. So one trie holds the
words, another the words reversed, and states start half-way down, where nodes have few edges.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import column, raw_texts
from ballotcredit.sources.sinks import written

# Fixed value: the letters of a word, A-Z, a-z and code points C0 to FF.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
PIECE = 1 << 20  # code points of a long text that are split at a time
NAMED = 32  # prefixes up to so many letters are nodes by their letters, longer ones by a digest
DEPTH = 2  # of the tries' roots: no state starts above


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces that part no run."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        run = RUN.match(text, end)
        if run:
            end = run.end()
        yield text[at:end]
        at = end
    yield text[at:]


def without_letter(run: str, number: int) -> str:
    i = number % len(run)
    return run[:i] + run[i + 1:]


def word_counts(docs: DataFrame, doc_id: str, text: str, every: int | None) -> DataFrame:
    """(word, n): the lower-cased runs of all texts, summed in each batch first."""
    slim = docs.select(column(docs, doc_id).alias("doc"), column(docs, text).alias("text"))

    def count(batches):
        for batch in batches:
            total = Counter()
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                found = Counter()
                for piece in _pieces(raw.lower().decode()):
                    found.update(RUN.findall(piece))
                if every is None:
                    total.update(found)
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for run, n in found.items():
                    check = zlib.crc32(run.encode(), start)
                    total[run if check % every else without_letter(run, check)] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["word", "n"])

    return slim.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _node(word: Column, length: Column) -> Column:
    prefix = F.substring(word, F.lit(1), length)
    return F.when(length <= NAMED, prefix).otherwise(
        F.concat_ws(":", length.cast("string"), F.md5(prefix)))


def _paths(words: DataFrame) -> DataFrame:
    """(side, word, stops): for each word, and each reversed word, the lengths of its nodes."""
    spelled = words.select(F.inline(F.array(
        F.struct(F.lit(0).alias("side"), F.col("word")),
        F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word")))))
    length = F.char_length("word")
    prefixes = (
        spelled.select("side", "word", F.explode(F.sequence(F.lit(DEPTH), length)).alias("stop"))
        .select("side", "word", "stop", _node(F.col("word"), F.col("stop")).alias("node"),
                F.substring(F.col("word"), F.col("stop") + 1, F.lit(1)).alias("next"))
    )
    nodes = (
        prefixes.groupBy("side", "node")
        .agg(F.min("next").alias("low"), F.max("next").alias("high"), F.min("stop").alias("depth"))
        .where(f"low <> high OR high = '' OR depth = {DEPTH}")
        .select("side", "node")
    )
    return prefixes.drop("next").join(nodes, ["side", "node"]).groupBy("side", "word").agg(
        F.sort_array(F.collect_list("stop")).alias("stops"))


def _edges(paths: DataFrame) -> DataFrame:
    """(side, node, first, label, child, ends, next): letters from node to child, whether a word
    ends there, and the first letters of the child's own edges."""
    pair = F.arrays_zip(F.slice("stops", F.lit(1), F.size("stops") - 1).alias("a"),
                        F.slice("stops", F.lit(2), F.size("stops") - 1).alias("b"))
    word, a, b = F.col("word"), F.col("p.a"), F.col("p.b")
    return (
        paths.where(F.size("stops") > 1).select("side", "word", F.explode(pair).alias("p"))
        .select("side", _node(word, a).alias("node"),
                F.substring(word, a + 1, b - a).alias("label"), _node(word, b).alias("child"),
                (b == F.char_length(word)).alias("ends"),
                F.substring(word, b + 1, F.lit(1)).alias("next"))
        .groupBy("side", "node", "label", "child").agg(
            F.max("ends").alias("ends"), F.array_join(F.collect_set("next"), "").alias("next"))
        .withColumn("first", F.substring("label", 1, 1))
    )


def _starts(paths: DataFrame) -> DataFrame:
    """A state without edits for each word, at its last node in the half it must share."""
    length = F.char_length("word")
    half = F.floor(length / 2)
    shared = F.when(F.col("side") == 0, half).otherwise(length - half)
    stop = F.array_max(F.filter("stops", lambda s: s <= shared))
    return paths.withColumn("at", stop).select(
        "side", "word", F.expr("substring(word, at + 1)").alias("rest"),
        _node(F.col("word"), F.col("at")).alias("node"), F.lit(None).cast("string").alias("near"))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states behind one more edge; ``found`` marks those that reached a neighbour's end.

    A state without edits goes on where its edge equals the word's letters, and ends with the word
    before its last letter. Elsewhere the first letter that differs lies inside the edge, which is
    the next letters of the neighbour: one letter of the word is replaced by a greater one, or left
    out. Every neighbour is met there, since its edges are followed as far as they equal the word.
    """
    ahead = F.expr("CASE WHEN left = '' THEN ends ELSE contains(next, left(left, 1)) END")
    # Letters that an edit leaves behind the edge, and the neighbour so far, or null.
    options = """CASE
        WHEN startswith(rest, label) THEN array(
            IF(char_length(rest) > n, struct(substring(rest, n + 1) AS left, CAST(NULL AS STRING) AS near),
               NULL),
            IF(ends AND char_length(rest) = n + 1, struct('' AS left, left(word, char_length(word) - 1)
               AS near), NULL))
        ELSE array(
            IF(char_length(rest) >= n AND label > left(rest, n) AND levenshtein(left(rest, n), label, 1) = 1,
               struct(substring(rest, n + 1) AS left, concat(head, label, substring(rest, n + 1)) AS near),
               NULL),
            IF(char_length(rest) > n AND levenshtein(left(rest, n + 1), label, 1) = 1,
               struct(substring(rest, n + 2) AS left, concat(head, label, substring(rest, n + 2)) AS near),
               NULL)) END"""
    met = (
        states.where("near IS NULL").drop("near").join(edges, ["side", "node"])
        .withColumn("n", F.char_length("label"))
        .withColumn("head", F.expr("left(word, char_length(word) - char_length(rest))"))
        .select("side", "word", "child", "ends", "next", F.explode(F.expr(options)).alias("option"))
        .where("option IS NOT NULL").select("side", "word", "child", "ends", "next", "option.*")
        .where(F.col("near").isNull() | ahead)
    )
    edited = (
        states.where("near IS NOT NULL").withColumn("first", F.substring("rest", 1, 1))
        .join(edges, ["side", "node", "first"]).where(F.expr("startswith(rest, label)"))
        .withColumn("left", F.expr("substring(rest, char_length(label) + 1)")).where(ahead)
        .select(*met.columns)
    )
    return met.unionByName(edited).select(
        "side", "word", F.col("left").alias("rest"), F.col("child").alias("node"), "near",
        (F.col("near").isNotNull() & (F.col("left") == "")).alias("found"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of ``words`` that differ by one inserted, deleted or replaced letter.

    Words are different and have four letters or more. Each pair is there in both directions.
    """
    paths = written(_paths(words))
    edges = written(_edges(paths))
    states, found = _starts(paths), []
    while True:
        level = written(_step(states, edges))
        found.append(level.where("found").select(
            F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word"),
            F.when(F.col("side") == 0, F.col("near")).otherwise(F.reverse("near")).alias("near")))
        states = level.where("NOT found").drop("found")
        if states.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.distinct()
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow each other; each is more frequent."""
    now = written(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        # A moved link is one whose end has a link itself; all are at their ends when none has.
        stepped = written(now.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"),
            F.col("further").isNotNull().alias("moved")))
        now = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return now


def spelling_forms(
    docs: DataFrame,
    min_chars: int = 5,
    min_count: int = 3,
    times: int = 2,
    damage: int | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words are maximal runs of letters, A-Z lower-cased, of ``min_chars`` code points (four at least)
    and ``min_count`` occurrences in all texts. ``damage`` plants misspellings: it deletes a letter
    of every run whose CRC-32 with the id it divides. A word's form is its near word, one edit away,
    of largest n (ties: least in code-point order) if that is at least ``times`` its own n, else
    null; root follows the forms to the last and is the word itself where there is none.

    A missing text has no words, a missing id counts as empty. Rows that repeat count each time.
    Other columns don't matter. An empty table gives none.
    """
    if min_chars < 2 * DEPTH or times < 2:
        raise ValueError("words need four letters, and a form must be more frequent")
    counts = written(word_counts(docs, doc_id, text, damage).where(
        (F.char_length("word") >= min_chars) & (F.col("n") >= min_count)))
    near = (
        neighbours(counts.select("word"))
        .join(counts.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
        .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                             F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    )
    forms = counts.join(near, "word", "left").withColumn("taken", -F.col("best.m") >= F.col("n") * times)
    table = written(forms.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("taken"), F.col("best.near")).alias("form"),
        F.when(F.col("taken"), -F.col("best.m")).alias("form_n")))
    roots = _roots(table.where("form IS NOT NULL"))
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
