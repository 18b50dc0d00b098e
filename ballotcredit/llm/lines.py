"""Line dedup: lines that occur in many documents are dropped from all of them.

Lines are exploded as hashes of their normalised form, the documents of each hash are counted,
hashes over the threshold are joined back, and each text is reassembled by position from the
lines that stay. Texts meet the hashes once; in between only ids and hashes are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballotcredit.llm.common import WHITE_SPACE, column, fresh, raw_texts, without
from ballotcredit.sources.sinks import written


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key (128 bits), None if the key is shorter than ``min_chars``."""
    key = line.strip(WHITE_SPACE)
    if len(key) < min_chars or (min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc, line): one row per document row and distinct key."""
    slim = docs.select(column(docs, doc_id).alias("doc"), column(docs, text).alias("text"))

    def explode(batches):
        for batch in batches:
            rows, keys = [], []
            for i, raw in enumerate(raw_texts(batch.column(1))):
                found = {_key(line, min_chars) for line in raw.lower().split(b"\n")} - {None}
                rows += [i] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(keys, pa.binary())],
                names=["doc", "line"],
            )

    kind = slim.schema["doc"].dataType.simpleString()
    return slim.mapInArrow(explode, f"doc {kind}, line binary")


def line_dedup(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    salts: int = 8,
) -> DataFrame:
    """``docs`` with the lines dropped whose key is found in ``min_docs`` documents or more.

    A line's key is the line without white space at its ends and with A-Z lower-cased; shorter
    keys than ``min_chars`` code points are never dropped. The result has all input columns, the
    text of the lines that stay joined by newlines, and n_lines (before) and n_dropped, which
    replace input columns of these names. Every occurrence of a frequent line goes, also the first.

    A missing or empty text is one empty line and becomes an empty text. Rows of the same id, a
    missing id included, count as one document; each row is kept. An empty table gives none.
    A hot line's rows are spread over ``salts`` parts; a frequent line is found in ``min_docs``
    documents at least, so its copies for the parts are no more than its rows.
    """
    pairs = written(line_hashes(docs, doc_id, text, min_chars))
    frequent = (
        pairs.distinct().groupBy("line").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs)
        .select("line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("part"))
    )
    spread = pairs.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    doc, found, cut = (fresh(docs.columns, n) for n in ("doc_", "found_", "cut_"))
    dropped = (
        spread.join(frequent, ["line", "part"]).groupBy("doc")
        .agg(F.collect_set("line").alias(found)).withColumnRenamed("doc", doc)
    )

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def reassemble(texts: pa.Array, gone: pa.Array) -> pa.Array:
        kept, total, less = [], [], []
        for raw, hashes in zip(raw_texts(texts), gone.to_pylist(), strict=True):
            lines = raw.split(b"\n")
            stay = lines
            if hashes:
                hashes = set(hashes)
                stay = [x for x in lines if _key(x.lower(), min_chars) not in hashes]
            kept.append(b"\n".join(stay))
            total.append(len(lines))
            less.append(len(lines) - len(stay))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
             pa.array(less, pa.int64())],
            names=["text", "n_lines", "n_dropped"],
        )

    source = without(docs, ["n_lines", "n_dropped"])
    joined = source.join(dropped, column(source, doc_id).eqNullSafe(F.col(doc)), "left")
    result = joined.withColumn(cut, reassemble(column(joined, text), F.col(found)))
    return result.select(
        [F.col(f"{cut}.text").alias(c) if c == text else column(result, c) for c in source.columns]
        + [F.col(f"{cut}.n_lines").alias("n_lines"), F.col(f"{cut}.n_dropped").alias("n_dropped")]
    )
