"""Corpus-wide line deduplication with DataFrame functions only.

Lines are normalised and hashed to 64 bits inside the row.  The distinct hashes of a document are exploded and
counted with map-side combining, the frequent ones are joined back to (hash, document) pairs, and each document
then drops its own frequent lines in place, so that text crosses the network once and line text never does.
A 64-bit hash can merge two lines; a rare line is lost only when it collides with one of the frequent ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, WHITE, lower_ascii, saved


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_key_chars: int = 1,
) -> DataFrame:
    """Drop every line whose key occurs in at least ``min_docs`` documents.

    Returns the input columns with ``text_col`` replaced by the kept lines, and ``n_lines`` and ``n_dropped``.
    Each row counts as a document, repeated ids included; rows with a null id are kept and cleaned too.
    A null text counts as one empty line and stays an empty text.  Keys shorter than ``min_key_chars`` code
    points never count.  Input columns called ``n_lines`` or ``n_dropped`` are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    hashes = F.transform(
        F.filter(
            F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.char_length(k) >= min_key_chars
        ),
        lambda k: F.xxhash64(k),
    )
    seen = docs.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(hashes)).alias("_h"))
    frequent = seen.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_docs).select("_h")
    # read back, it has a shuffle of its own or is broadcast by its size; either way Spark can split a very common line
    frequent = saved(frequent, "frequent-lines")
    per_doc = seen.join(frequent, "_h").groupBy("_id").agg(F.collect_set("_h").alias("_hot"))
    marked = docs.join(per_doc, docs[id_col].eqNullSafe(per_doc["_id"]), "left").drop("_id")
    marked = marked.withColumn("_lines", lines_of(F.col(text_col)))
    kept = F.when(F.col("_hot").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains(F.col("_hot"), F.xxhash64(line_key(x))))
    )
    marked = marked.withColumn("_kept", kept)
    return (
        marked.withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dropped", (F.size("_lines") - F.size("_kept")).cast("long"))
        .withColumn(text_col, F.array_join("_kept", "\n"))
        .drop("_lines", "_kept", "_hot")
    )


def op3_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_STRIP = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SQL = f"""
WITH lines AS (
  SELECT d.doc_id, u.i, u.line, translate(trim(u.line, {_STRIP}), '{UPPER}', '{LOWER}') AS k
  FROM documents d, LATERAL (
    SELECT unnest(string_split(coalesce(d.text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(d.text, ''), chr(10)), 1) AS i) u
), hot AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(h.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE h.k IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.k = h.k
GROUP BY l.doc_id
"""
