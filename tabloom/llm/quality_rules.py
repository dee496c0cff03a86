"""Line-first quality rules with DataFrame functions only.

Every line is judged by itself (navigation, decoration, shouting, fragments without punctuation, boilerplate); the
lines that fail are removed; a document is rejected when too much of its text went with them.  A set of document
counts (words, symbols, repeated lines, repeated 3-word windows) forms the base gate.  All of it happens inside the
row with array functions, so nothing is shuffled whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import WHITE

#: Fixed phrases of page furniture; a short line that holds one of them is boilerplate.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to",
    "share this",
    "powered by",
)
_WS = "[ \\t\\n\\x0B\\f\\r]+"
#: Above this many different repeated windows, positions are found by sorting instead of by lookup.
_FEW = 32


def _occurrences(text: Column, what: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(what), F.lit("")))


def line_fails(
    line: Column,
    boilerplate: Sequence[str] = BOILERPLATE,
    fragment_words: int = 5,
    boilerplate_words: int = 15,
) -> Column:
    """Whether a line is navigation, decoration, shouting, an unpunctuated fragment or boilerplate."""
    trimmed = F.btrim(line, F.lit(WHITE))
    words = _occurrences(trimmed, " ") + 1
    navigation = _occurrences(trimmed, "|") + _occurrences(trimmed, ">") + _occurrences(trimmed, "»")
    decoration = F.regexp_count(trimmed, F.lit("[#*$%&<>]"))
    shouting = _occurrences(trimmed, "!")
    punctuated = F.substring(trimmed, -1, 1).isin(*".!?:;,\"')]…»”。！？")
    phrase = F.lit(False)
    low = F.lower(trimmed)
    for p in boilerplate:
        phrase = phrase | low.contains(p)
    return (
        (trimmed != "")
        & (
            ((navigation >= 2) & (navigation * 3 >= words))
            | ((decoration >= 3) & (decoration * 2 >= words))
            | ((shouting >= 3) & (shouting * 2 >= words))
            | ((words < fragment_words) & ~punctuated)
            | ((words <= boilerplate_words) & phrase)
        )
    )


def _repeated(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more; ``words`` is an array of strings."""
    grams = F.when(
        F.size(words) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))
    return grams


def _covered(starts: Column) -> Column:
    """How many words the 3-word windows at the ascending positions ``starts`` cover."""
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
        F.lit(3)
        + F.aggregate(
            F.zip_with(
                F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))),
                lambda b, a: F.least(b - a, F.lit(3)),
            ),
            F.lit(0),
            lambda s, x: s + x,
        )
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of every whole text.

    A null or blank text has no words and zeros.  Columns of these names in the input are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    trimmed = F.btrim(text, F.lit(WHITE))
    d = docs.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WS)))
    d = d.withColumn("_l", F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    d = d.withColumn("_g", _repeated(F.col("_w")))
    d = d.withColumn("_s", F.sort_array("_g"))
    d = d.withColumn(
        "_d",
        F.array_distinct(F.filter("_s", lambda x, i: (i > 0) & (x == F.col("_s")[F.greatest(i - 1, F.lit(0))]))),
    )
    positions = F.sequence(F.lit(0), F.greatest(F.size("_g") - 1, F.lit(0)))
    looked_up = F.filter(positions, lambda i: F.array_contains(F.col("_d"), F.col("_g")[i]))
    d = d.withColumn(
        "_p",
        F.when(
            F.size("_d") > _FEW,
            F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    )
    last = F.size("_p") - 1
    by_sorting = F.sort_array(
        F.transform(
            F.filter(
                "_p",
                lambda x, j: ((j > 0) & (F.col("_p")[F.greatest(j - 1, F.lit(0))]["g"] == x["g"]))
                | ((j < last) & (F.col("_p")[F.least(j + 1, last)]["g"] == x["g"])),
            ),
            lambda x: x["i"],
        )
    )
    d = d.withColumn(
        "_at",
        F.when(F.size("_d") == 0, F.array().cast("array<int>"))
        .when(F.size("_d") <= _FEW, looked_up)
        .otherwise(by_sorting),
    )
    return (
        d.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", _covered(F.col("_at")).cast("long"))
        .drop("_w", "_l", "_g", "_s", "_d", "_p", "_at")
    )


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost_percent: int = 40,
) -> DataFrame:
    """Judge every document.

    Returns the input columns, the counts of :func:`with_counts`, ``cleaned`` (the text without failed lines),
    ``n_failed_lines``, ``lost_chars``, ``base_failed`` and ``kept``.  ``base_failed``: fewer than ``min_words``
    words, or more than ``max_repeat_percent`` of them in repeated windows.  ``kept``: not base_failed, and at most
    ``max_lost_percent`` of the characters lost with failed lines.  A null text is an empty one and fails the base.
    """
    d = with_counts(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = d.withColumn("_lines", F.split(text, "\n", -1))
    d = d.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x)))
    d = d.withColumn("cleaned", F.array_join("_good", "\n"))
    d = d.withColumn("n_failed_lines", (F.size("_lines") - F.size("_good")).cast("long"))
    d = d.withColumn("lost_chars", (F.char_length(text) - F.char_length("cleaned")).cast("long")).drop("_lines", "_good")
    d = d.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent),
    )
    return d.withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.char_length(text) * max_lost_percent)
    )


def op6_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_TRIM = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _count(what: str) -> str:
    return f"(length(t) - length(replace(t, '{what}', '')))"


_PHRASES = " OR ".join(f"contains(lower(t), '{p}')" for p in BOILERPLATE)
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), w AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d
), g AS (
  SELECT doc_id, i, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i FROM g WHERE z IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, x, y, z) > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + j.k) AS n FROM r, (VALUES (0), (1), (2)) j(k) GROUP BY doc_id
), l0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), l AS (
  SELECT *, trim(line, {_TRIM}) AS t FROM l0
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE t <> '' GROUP BY doc_id
), f AS (
  SELECT doc_id, line, i, t <> '' AND (
    ({_count('|')} + {_count('>')} + {_count(chr(0xBB))} >= 2 AND 3 * ({_count('|')} + {_count('>')} + {_count(chr(0xBB))}) >= {_count(' ')} + 1)
    OR (length(t) - length(regexp_replace(t, '[#*$%&<>]', '', 'g')) >= 3
        AND 2 * (length(t) - length(regexp_replace(t, '[#*$%&<>]', '', 'g'))) >= {_count(' ')} + 1)
    OR ({_count('!')} >= 3 AND 2 * {_count('!')} >= {_count(' ')} + 1)
    OR ({_count(' ')} + 1 < 5 AND NOT contains('.!?:;,"'')]…»”。！？', right(t, 1)))
    OR ({_count(' ')} + 1 <= 15 AND ({_PHRASES}))) AS bad
  FROM l
), k AS (
  SELECT doc_id, length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '')) AS n FROM f GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(d.text) AS chars, coalesce(k.n, 0) AS kept_chars
  FROM d LEFT JOIN dup ON d.doc_id = dup.doc_id LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (chars - kept_chars) <= 40 * chars AS kept
FROM m
"""
