"""Registered queries of the text operators, with production parameters, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballotcredit.llm import (
    credentials,
    decontam,
    fim,
    html_text,
    licenses,
    lines,
    lm,
    mixing,
    neardup,
    repeats,
    spelling,
    topk,
    toxicity,
)
from ballotcredit.llm.common import word_count
from ballotcredit.sources.sinks import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=5, percent=75)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"), fold=(7, 2), weight=0.4)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 20 = 0"), k=20, scale=64)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"), fold=(5, 0))
    scored = toxicity.score_toxicity(docs, machine, name="score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id"), (5, 0)).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = credentials.scan_credentials(docs, credentials.learn_formats(docs))
    base = F.filter("spans", lambda s: s.kind != "format")

    def listed(spans):
        return F.array_join(F.transform(
            spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"),
                        number("format"), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixing.mix_sources(sized, size="size").select(
        "doc_id", "size", "source_size", "target", "taken")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, coverage=0.9)
    return found.select("doc_id", F.inline("licenses"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=8,
        coverage=0.5)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.spelling_forms(docs, min_chars=5, min_count=3, times=2, damage=97).select(
        "word", "form", "root", "n", "n_near", "form_n")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.fill_in_middle(docs, seed=7, fim_percent=100, spm_percent=50)
    return fim.restore_text(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_near_dedup, op3_lm_score, op4_exact_topk, op5_toxicity,
              op6_secret_scan, op7_source_mix, op8_license_scan, op9_decontamination, op10_html_text,
              op11_suffix_dedup, op12_spelling_variants, op13_fill_in_middle)
}

_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), one AS (
  SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_WS}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM one
), frequent AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op2_near_dedup": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3),
        lambda i: array_to_string(words[i:i + 4], ' ')) END AS all_shingles
    FROM split WHERE len(words) > 0), unnest(all_shingles) AS u(shingle)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM met JOIN sizes s ON u = s.doc_id JOIN sizes t ON v = t.doc_id
  WHERE 100 * common >= 75 * (s.n + t.n - common)
), reached AS (
  SELECT u, v FROM links
  UNION
  SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), least AS (
  SELECT u, min(v) AS low FROM reached GROUP BY u
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles,
  least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  least(d.doc_id, coalesce(low, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.u""",
    "op4_exact_topk": """
WITH ints AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM ints q JOIN ints c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_suffix_dedup": """
WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hex, strlen(coalesce(text, '')) AS n_bytes
  FROM documents
), strings AS (
  SELECT doc_id, i, md5(hex[2 * i + 1:2 * i + 200]) AS string
  FROM bytes, unnest(range(0, n_bytes - 99)) AS u(i)
), gone AS (
  SELECT doc_id, i FROM strings
  QUALIFY row_number() OVER (PARTITION BY string ORDER BY doc_id, i) > 1
), steps AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER w + 100, true) AS new FROM gone
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps)
  GROUP BY doc_id, span
), pieces AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), cut AS (
  SELECT p.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
    string_agg(hex[2 * before + 1:2 * a], '' ORDER BY a) AS kept
  FROM pieces p JOIN bytes USING (doc_id) GROUP BY p.doc_id
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex[2 * coalesce(last, 0) + 1:])) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)""",
    # CRC-32 bit by bit; near words by the letter left out of either or both.
    "op12_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n, (coalesce(doc_id::VARCHAR, '') || ':' || run) AS name
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
    FROM documents) GROUP BY doc_id, run
), coded AS (
  SELECT run, n, flatten(list_transform(string_split(name, ''), lambda c: CASE
    WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes
  FROM runs
), checked AS (
  SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(bytes, lambda b:
    list_transform(range(8), lambda i: (b >> i) & 1))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1)), 4294967295)) AS h
  FROM coded
), counts AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::BIGINT)
    || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM checked GROUP BY 1
), words AS (
  SELECT word, n FROM counts WHERE length(word) >= 5 AND n >= 3
), less AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), pairs AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)
), ranked AS (
  SELECT p.word, p.near, m.n AS m, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY m.n DESC, encode(p.near)) AS place
  FROM pairs p JOIN words m ON p.near = m.word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN near END AS form,
    CASE WHEN m >= 2 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1
), steps AS (
  SELECT word, word AS stop, 0 AS far FROM forms
  UNION ALL
  SELECT s.word, f.form, far + 1 FROM steps s JOIN forms f ON s.stop = f.word
  WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(stop, far) AS root FROM steps GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
    "op13_fill_in_middle": r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), numbers AS (
  SELECT *, len(units) AS n, ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
    ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM drawn
), cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts""",
}
