"""Names to parties (exact, reversed, fuzzy), numbers to ranges, headers to their constituency."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tabloom.functions.reversal import title_case
from tabloom.functions.text import initials_first, strip_titles
from tabloom.operators.labels import _checked
from tabloom.operators.merge import COPIES, counted, repeated

#: Parties that need no lookup, headers that are no candidates, and the number ranges of sections.
KNOWN_PARTIES = ("DMK", "AIADMK", "BJP", "INC", "PMK", "NTK", "VCK", "CPI", "CPI(M)", "DMDK", "MDMK", "TMC(M)", "AMMK", "IUML", "IND")
NOT_CANDIDATES = (
    "sl. no", "sl.no", "slno", "s.no", "s no", "serial number", "sr no", "sr. no", "ps no.", "ps no",
    "polling station no", "polling station number", "total", "total votes", "total valid votes", "grand total", "sum",
    "total votes polled", "total electors", "nota", "none of the above", "overseas electors", "service electors",
    "postal ballot", "tendred votes", "challenged votes", "remarks", "notes", "date", "time", "place", "constituency",
    "constituency name", "assembly constituency", "part no", "part number", "booth no", "booth number", "percentage",
    "%", "rank", "position",
)
SECTIONS = (
    (1, 43, "Ariyalur North"), (70, 83, "Ariyalur North"), (107, 109, "Ariyalur North"), (84, 106, "Ariyalur South"),
    (110, 140, "Ariyalur South"), (44, 69, "Ariyalur Town"), (141, 164, "Thirumanur West"), (168, 185, "Thirumanur West"),
    (240, 265, "Thirumanur West"), (165, 167, "Thirumanur East"), (186, 239, "Thirumanur East"),
    (266, 277, "Jayankondam ALU"), (278, 330, "T Palur West"),
)
#: The sections' names in Tamil.
SECTIONS_TAMIL = {
    "Ariyalur North": "அரியலூர் வடக்கு", "Ariyalur South": "அரியலூர் தெற்கு", "Ariyalur Town": "அரியலூர் நகரம்",
    "Thirumanur West": "திருமானூர் மேற்கு", "Thirumanur East": "திருமானூர் கிழக்கு",
    "Jayankondam ALU": "ஜெயங்கொண்டம் ஏ.எல்.யு", "T Palur West": "டி பழூர் மேற்கு",
}
#: Names that several candidates bear, with marks in the text or a constituency (neither: always), and
#: the party; the first that fits counts.
SHARED_NAMES = (
    ("annadurai", ("c. n.", "c.n."), "tiruvannamalai", "DMK"),
    ("annadurai", (), "", "PMK"),
    ("senthilnathan", ("v. v.", "v.v."), "karur", "BJP"),
    ("senthilnathan", ("p.",), "tiruchirappalli", "AMMK"),
    ("venkatesan", ("jothi",), "kancheepuram", "PMK"),
    ("venkatesan", ("su.",), "madurai", "CPI(M)"),
    ("mani", ("a. mani",), "dharmapuri", "DMK"),
    ("mani", ("tamil mani",), "namakkal", "AIADMK"),
)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by longest matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def collision(text: Column, constituency: Column) -> Column:
    """The party of names that several candidates bear, by the first of ``SHARED_NAMES`` that fits; null if none does."""
    t, c = F.lower(text), F.lower(F.coalesce(constituency, F.lit("")))
    rules = []
    for name, marks, place, party in SHARED_NAMES:
        signs = [t.contains(m) for m in marks] + ([c.contains(place)] if place else [])
        rules.append(F.when(reduce(Column.__or__, signs, F.lit(not signs)) & t.contains(name), party))
    return F.coalesce(*rules)


def close_match(left: DataFrame, right: DataFrame, a: str, b: str, block: list[str], cutoff: float) -> DataFrame:
    """``left`` with the closest ``b`` of the same block and its ``score``; equals go to the larger string.

    Repeated rows of ``left`` stay; rows without a close ``b`` are left out.
    """
    keys = left.columns
    # a ratio r needs lengths within 2/r - 1 of each other, which spares most comparisons
    near = F.length(a) * (2 / cutoff - 1) >= F.length(b)
    near = near & (F.length(b) * (2 / cutoff - 1) >= F.length(a))
    pairs = counted(left).join(right, block).where(near).withColumn("score", ratio(F.col(a), F.col(b))).where(F.col("score") >= cutoff)
    best = pairs.groupBy(*keys, COPIES).agg(F.max_by(F.struct(*[c for c in right.columns if c not in block]), F.struct("score", b)).alias("m"), F.max("score").alias("score"))
    return repeated(best.select(*keys, COPIES, "m.*", "score"))


def _characters(text: Column) -> Column:
    """array<string>: each character with how often it has come, so that common ones of two texts are counted as a multiset."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def close_match_anywhere(left: DataFrame, right: DataFrame, a: str, b: str, cutoff: float) -> DataFrame:
    """``close_match`` without blocks: ``left`` with the closest ``b`` of all of ``right``, from an inverted index of characters.

    Texts of lengths n and m with a ratio of ``cutoff`` have cutoff * (n + m) / 2 characters in common, and m is at least
    n * cutoff / (2 - cutoff): so one of n has at least that many in common with any other.  With the characters in one
    order, the rarest of ``right`` first, such texts share one of those that come before the last so many of each.  Only
    texts that share one are compared, each pair once; there is no key that all rows have.
    """
    share = cutoff / (2 - cutoff)
    mine, theirs = left.select(a).where(F.col(a) != "").distinct(), right.select(b).where(F.col(b) != "").distinct()
    given = theirs.select(b, F.char_length(b).alias("_m"), F.explode(_characters(F.col(b))).alias("_t"))
    counts = given.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    asked = mine.select(a, F.char_length(a).alias("_l"), F.explode(_characters(F.col(a))).alias("_t"))

    def shown(tokens: DataFrame, text: str, size: str) -> DataFrame:
        least = F.ceil(F.col(size) * share - 1e-9).cast("int")
        listed = tokens.join(counts, "_t").groupBy(text, size).agg(F.array_sort(F.collect_list(F.struct("_n", "_t"))).alias("_s"))
        first = F.slice("_s", F.lit(1), F.greatest(F.size("_s") - least + 1, F.lit(0)))
        return listed.select(text, size, F.explode(first).alias("_x")).select(text, size, "_x._t")

    near = (F.col("_l") * (2 / cutoff - 1) >= F.col("_m")) & (F.col("_m") * (2 / cutoff - 1) >= F.col("_l"))
    pairs = shown(asked, a, "_l").join(shown(given, b, "_m"), "_t").where(near).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    scored = pairs.withColumn("score", ratio(F.col("_a"), F.col("_b"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("_a").agg(F.max(F.struct("score", "_b")).alias("_best")).select("_a", "_best.*")
    # rows of ``right`` with one text: the one that sorts last
    row = right.groupBy(F.col(b).alias("_b")).agg(F.max(F.struct(*right.columns)).alias("_m")).select("_b", "_m.*")
    return left.join(best, left[a] == best["_a"]).join(row, "_b").select(*left.columns, *[row[c] for c in right.columns], "score")


def candidates_in_constituency(headers: DataFrame, candidates: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """(text, constituency, candidate, party, confidence, rung) of headers that name a candidate there.

    Rungs, each for what the ones before left over: 1 exact, 2 title case, 3 reversed, 4 reversed and close without
    titles, 5 reversed with initials first and close, 6 close.  ``candidates``: constituency, candidate, party.
    """
    asked = headers.select("text", "constituency").distinct().where(F.col("text").isNotNull() & F.col("constituency").isNotNull())
    asked = asked.withColumn("t", F.trim("text")).where((F.col("t") != "") & ~F.lower("t").isin(*NOT_CANDIDATES))
    asked = asked.withColumn("title", title_case("t")).withColumn("back", title_case(F.reverse("t")))
    asked = asked.withColumn("plain_back", strip_titles(F.col("back"))).withColumn("turned", initials_first(F.col("back")))
    own = _checked(candidates.withColumn("plain", strip_titles(F.col("candidate"))))
    exact = asked.join(own, "constituency").withColumn(
        "rung", F.when(F.col("t") == F.col("candidate"), 1).when(F.col("title") == F.col("candidate"), 2).when(F.col("back") == F.col("candidate"), 3)
    )
    found = exact.where("rung IS NOT NULL").groupBy("text", "constituency").agg(F.min_by(F.struct("candidate", "party", "rung"), "rung").alias("m"))
    found = found.select("text", "constituency", "m.candidate", "m.party", F.lit(1.0).alias("confidence"), "m.rung")
    for rung, mine, theirs in ((4, "plain_back", "plain"), (5, "turned", "candidate"), (6, "title", "candidate")):
        left = asked.join(found, ["text", "constituency"], "left_anti").select("text", "constituency", mine)
        if rung == 5:
            left = left.where(F.col(mine).contains(" "))
        near = close_match(left, own, mine, theirs, ["constituency"], cutoff)
        found = found.union(near.select("text", "constituency", "candidate", "party", F.col("score"), F.lit(rung)))
    return found


def normalize_headers(headers: DataFrame, candidates: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """Headers (text, constituency) with ``party``: collision rules, known parties, candidates, else the text itself."""
    found = candidates_in_constituency(headers, candidates, cutoff).select("text", "constituency", F.col("party").alias("_p"), "confidence")
    joined = headers.join(found, ["text", "constituency"], "left")
    known = F.when(F.upper(F.trim("text")).isin(*KNOWN_PARTIES), F.upper(F.trim("text")))
    party = F.coalesce(collision(F.col("text"), F.col("constituency")), known, F.col("_p"), F.col("text"))
    return joined.withColumn("party", party).drop("_p")


def legacy_ladder(values: DataFrame, candidates: DataFrame) -> DataFrame:
    """Values (text, constituency) with ``party`` from all candidates: collisions, parties, exact, title case,
    reversed, close when reversed (0.7), initials first (0.7), close (0.7, then 0.6), else unchanged."""
    asked = values.select("text").distinct().where("text IS NOT NULL").withColumn("t", F.trim("text"))
    asked = asked.where((F.col("t") != "") & ~F.lower("t").isin(*NOT_CANDIDATES))
    asked = asked.withColumn("title", title_case("t")).withColumn("back", title_case(F.reverse("t")))
    asked = asked.withColumn("plain_back", strip_titles(F.col("back"))).withColumn("turned", initials_first(F.col("back")))
    own = candidates.select("candidate", "party", strip_titles(F.col("candidate")).alias("plain"))
    forms = asked.select("text", F.posexplode(F.array("t", "title", "back")).alias("rung", "candidate"))
    exact = forms.join(own.select("candidate", "party"), "candidate").groupBy("text").agg(F.min(F.struct("rung", "party")).alias("m"))
    found = exact.select("text", "m.party")
    for mine, theirs, cutoff in (("plain_back", "plain", 0.7), ("turned", "candidate", 0.7), ("title", "candidate", 0.7), ("title", "candidate", 0.6)):
        left = asked.join(found, "text", "left_anti").select("text", mine)
        if mine == "turned":
            left = left.where(F.col(mine).contains(" "))
        near = close_match_anywhere(left, own.select(F.col(theirs).alias("_theirs"), "party"), mine, "_theirs", cutoff)
        found = found.union(near.select("text", "party"))
    joined = values.join(found.withColumnRenamed("party", "_p"), "text", "left")
    known = F.when(F.upper(F.trim("text")).isin(*KNOWN_PARTIES), F.upper(F.trim("text")))
    return joined.withColumn("party", F.coalesce(collision(F.col("text"), F.col("constituency")), known, F.col("_p"), F.col("text"))).drop("_p")


def majority_constituency(headers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(table_id, constituency, n): the constituency most of a table's headers name; the first of equals."""
    named = headers.join(_checked(candidates), F.lower(F.trim("header")) == F.lower(F.trim("candidate")))
    votes = named.groupBy("table_id", "constituency").agg(F.count(F.lit(1)).alias("n"), F.min("col_idx").alias("first"))
    best = votes.groupBy("table_id").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "constituency")).alias("b"))
    return best.select("table_id", "b.constituency", "b.n")


def section_ranges(spark: SparkSession) -> DataFrame:
    """(lo, hi, section, section_tamil)."""
    return spark.createDataFrame([(*s, SECTIONS_TAMIL[s[2]]) for s in SECTIONS], "lo int, hi int, section string, section_tamil string")


def range_lookup(df: DataFrame, value: str, ranges: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Left join of the range that holds ``value``; ranges do not overlap, values outside have nulls."""
    v = F.col(value) if dict(df.dtypes)[value] != "string" else F.col(value).try_cast("int")
    return df.join(_checked(ranges), v.between(F.col(lo), F.col(hi)), "left").drop(lo, hi)


def last_wins(lookup: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    return lookup.groupBy(key).agg(F.max_by(value, pos).alias(value))


def nearest(left: DataFrame, right: DataFrame, block: str, a: str, b: str, reach: float, right_id: str) -> DataFrame:
    """The right row of the same block nearest in value and within reach; the smaller id of equals.

    Repeated rows of ``left`` stay; rows with nothing in reach are left out.
    """
    pairs = counted(left).join(right, block).where(F.abs(F.col(a) - F.col(b)) < reach)
    keys = left.columns
    cols = [c for c in right.columns if c != block]
    best = pairs.groupBy(*keys, COPIES).agg(F.min_by(F.struct(*cols), F.struct(F.abs(F.col(a) - F.col(b)), right_id)).alias("m"))
    return repeated(best.select(*keys, COPIES, "m.*"))


def positional_zip(left: DataFrame, right: DataFrame, block: str, left_order: str, right_order: str) -> DataFrame:
    """The n-th row of the left with the n-th row of the right in each block."""
    a = left.withColumn("_n", F.row_number().over(W.partitionBy(block).orderBy(left_order)))
    b = right.withColumn("_n", F.row_number().over(W.partitionBy(block).orderBy(right_order)))
    return a.join(b, [block, "_n"], "left").drop("_n")
