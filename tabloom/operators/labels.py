"""Header to canonical label with a score, by one theta join against small broadcast dictionaries.

A dictionary has ``pos, label, kind, variants, abbreviations``; its size is that of a configuration, checked against
``MAX_DICTIONARY`` before it is broadcast.  Headers are distinct before they meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import column_normal_form, jaccard, match_form, reversal_forms, tail_after_dash, tokens

MAX_DICTIONARY = 10_000

#: Parties in order of trust, with abbreviations and names.
PARTIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("DMK Votes", ("DMK",), ("DRAVIDA MUNNETRA KAZHAGAM", "D M K")),
    ("AIADMK Votes", ("AIADMK",), ("ALL INDIA ANNA DRAVIDA MUNNETRA KAZHAGAM", "ANNA DRAVIDA MUNNETRA KAZHAGAM", "A I A D M K")),
    ("BJP Votes", ("BJP",), ("BHARATIYA JANATA PARTY", "BHARATIHA JANATA PARTY", "JANATA PARTY", "B J P")),
    ("NCP Votes", ("NCP",), ("NATIONALIST CONGRESS PARTY", "N C P")),
    ("CONGRESS Votes", ("CONGRESS", "INC"), ("INDIAN NATIONAL CONGRESS", "CONGRESS", "I N C")),
    ("PMK Votes", ("PMK",), ("PATTALI MAKKAL KATCHI",)),
    ("VCK Votes", ("VCK",), ("VIDUTHALAI CHIRUTHAIGAL KATCHI",)),
    ("NTK Votes", ("NTK",), ("NAAM TAMILAR KATCHI", "NAAM TAMIZHAR KATCHI")),
    ("DMDK Votes", ("DMDK",), ("DESIYA MURPOKKU DRAVIDA KAZHAGAM", "MURPOKKU DRAVIDA KAZHAGAM")),
    ("MDMK Votes", ("MDMK",), ("MARUMALARCHI DRAVIDA MUNNETRA KAZHAGAM",)),
    ("AMMK Votes", ("AMMK",), ("AMMA MAKKAL MUNNETRA KAZHAGAM",)),
    ("NDK Votes", ("NDK",), ("NAADAALUM MAKKAL KATCHI",)),
    ("CPI(M) Votes", ("CPIM", "CPI(M)", "CPM"), ("COMMUNIST PARTY OF INDIA MARXIST",)),
    ("CPI Votes", ("CPI",), ("COMMUNIST PARTY OF INDIA",)),
    ("TMC(M) Votes", ("TMC", "TMCM", "TMC(M)"), ("TAMIL MAANILA CONGRESS", "TAMIL MAANILA CONGRESS MOOPANAR")),
    ("IUML Votes", ("IUML",), ("INDIAN UNION MUSLIM LEAGUE",)),
    ("AIFB Votes", ("AIFB",), ("ALL INDIA FORWARD BLOC",)),
    ("RPI(A) Votes", ("RPIA", "RPI(A)", "RPI"), ("REPUBLICAN PARTY OF INDIA ATHAWALE", "REPUBLICAN PARTY OF INDIA")),
    ("BSP Votes", ("BSP",), ("BAHUJAN SAMAJ PARTY",)),
    ("MNM Votes", ("MNM",), ("MAKKAL NEEDHI MAIAM",)),
    ("IJK Votes", ("IJK",), ("INDIA JANANAYAKA KATCHI", "INDIYA JANANAYAKA KATCHI", "INDIA JANAYAKA KATCHI", "INDIYA JANAYAKA KATCHI")),
    ("KMDK Votes", ("KMDK",), ("KONGUNADU MAKKAL DESIA KATCHI", "KONGUNADU MAKKAL DESIYA KATCHI")),
    ("MMK Votes", ("MMK",), ("MANITHANEYA MAKKAL KATCHI",)),
    ("SDPI Votes", ("SDPI",), ("SOCIAL DEMOCRATIC PARTY OF INDIA",)),
    ("PT Votes", ("PT",), ("PUTHIYA TAMILAGAM",)),
    ("AIMIM Votes", ("AIMIM",), ("ALL INDIA MAJLIS E ITTEHADUL MUSLIMEEN", "MAJLIS E ITTEHADUL MUSLIMEEN")),
    ("TMK Votes", ("TMK",), ("TAMILAGA MAKKAL KATCHI",)),
    ("IND Votes", ("IND", "INDEPENDENT"), ("INDEPENDENT",)),
    ("NOTA Votes", ("NOTA",), ("NONE OF THE ABOVE",)),
)
#: Fixed labels that need a score of 0.90; the others need 0.85.
MAJOR = ("DMK Votes", "AIADMK Votes", "BJP Votes", "CONGRESS Votes", "PMK Votes", "VCK Votes", "NTK Votes", "AMMK Votes", "DMDK Votes")
#: Administrative columns, their role, abbreviations and names.
ADMIN: tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("Polling Station No.", "identifier", ("PSNO", "PS NO"), ("POLLING STATION NO", "POLLING STATION NUMBER", "PS NO", "PSNO", "P S NO", "BOOTH NO", "BOOTH NUMBER", "BOOTH", "POLLING BOOTH NO", "POLLING BOOTH NUMBER", "POLLING BOOTH", "STATION NO", "STATION NUMBER", "STN NO")),
    ("Polling Station Name", "location", (), ("POLLING STATION NAME", "POLLING STATION LOCATION", "PS NAME", "STATION NAME", "BOOTH NAME", "BOOTH LOCATION", "POLLING BOOTH NAME", "LOCATION", "BUILDING NAME", "NAME OF POLLING STATION", "NAME OF THE POLLING STATION")),
    ("SL. NO.", "identifier", ("SLNO", "SL NO"), ("SL NO", "S NO", "SERIAL NO", "SERIAL NUMBER", "SR NO")),
    ("AC NO.", "identifier", ("ACNO", "AC NO"), ("AC NO", "A C NO", "ASSEMBLY CONSTITUENCY NO", "ASSEMBLY CONSTITUENCY NUMBER", "CONSTITUENCY NO", "CONSTITUENCY NUMBER")),
    ("Total Valid Votes", "count", (), ("TOTAL VALID VOTES", "TOTAL VOTES", "TOTAL VALID VOTES POLLED", "TOTAL VOTES POLLED", "VALID VOTES", "VOTES POLLED", "TOTAL")),
    ("Rejected Votes", "count", (), ("REJECTED VOTES", "REJECTED", "INVALID VOTES", "REJECTED BALLOT", "REJECTED BALLOTS", "NO OF REJECTED VOTES")),
    ("Tendered Votes", "count", (), ("TENDERED VOTES", "TENDERED", "NO OF TENDERED VOTES")),
    ("Total Electors", "count", (), ("TOTAL ELECTORS", "ELECTORS", "NO OF ELECTORS", "TOTAL VOTERS", "VOTERS", "REGISTERED VOTERS")),
)
_DICTIONARY = "pos int, label string, kind string, variants array<string>, abbreviations array<string>"


def party_dictionary(spark: SparkSession) -> DataFrame:
    rows = [(i, label, "party", [*v], [*a]) for i, (label, a, v) in enumerate(PARTIES)]
    return spark.createDataFrame(rows, _DICTIONARY)


def admin_dictionary(spark: SparkSession) -> DataFrame:
    rows = [(i, label, kind, [*v], [*a]) for i, (label, kind, a, v) in enumerate(ADMIN)]
    return spark.createDataFrame(rows, _DICTIONARY)


def _checked(dictionary: DataFrame) -> DataFrame:
    """Broadcast a dictionary of a checked size; a larger one is left to the planner."""
    return F.broadcast(dictionary) if dictionary.limit(MAX_DICTIONARY + 1).count() <= MAX_DICTIONARY else dictionary


def _contains(a: Column, b: Column, legacy: bool) -> Column:
    """``a`` holds ``b``, or the other way round if ``b`` has two words at least (always, if ``legacy``)."""
    long = F.lit(True) if legacy else F.size(F.split(a, " ")) >= 2
    return a.contains(b) | (long & b.contains(a))


def match_labels(
    headers: DataFrame, dictionary: DataFrame, header_col: str = "header", reversals: bool = True, legacy_containment: bool = False
) -> DataFrame:
    """Distinct headers with ``label, kind, confidence`` of the best entry; the first of equals; unmatched are left out.

    An abbreviation counts 1.0 exactly, 0.98 as a word, 0.85 inside a word if longer than 3; a name 1.0 exactly, 0.92
    when one holds the other, else the Jaccard similarity of words that share two or more.
    """
    forms = reversal_forms if reversals else F.array
    raw = headers.select(header_col).distinct().withColumn("_f", match_form(F.col(header_col)))
    raw = raw.withColumn("_t", match_form(tail_after_dash(F.col(header_col)))).where("_f <> ''")
    raw = raw.withColumn("_forms", F.filter(F.array_distinct(F.concat(forms(F.col("_f")), forms(F.col("_t")))), lambda f: f != ""))
    entries = _checked(dictionary).withColumn("_abbr", F.transform("abbreviations", match_form)).withColumn(
        "_names", F.array_distinct(F.flatten(F.transform("variants", lambda v: forms(match_form(v)))))
    )
    pairs = raw.select(header_col, F.explode("_forms").alias("_form")).join(entries, F.lit(True))
    form = F.col("_form")

    def squashed(c: Column) -> Column:
        return F.replace(c, F.lit(" "), F.lit(""))

    word = F.concat(F.lit(" "), form, F.lit(" "))
    by_abbr = F.transform(
        "_abbr",
        lambda a: F.when(form == a, 1.0)
        .when(word.contains(F.concat(F.lit(" "), a, F.lit(" "))), 0.98)
        .when((F.length(a) > 3) & form.contains(a), 0.85)
        .otherwise(0.0),
    )
    by_name = F.transform(
        "_names",
        lambda v: F.when((form == v) | (squashed(form) == squashed(v)), 1.0)
        .when(_contains(form, v, legacy_containment), 0.92)
        .when(F.size(F.array_intersect(tokens(form), tokens(v))) >= 2, jaccard(tokens(form), tokens(v)))
        .otherwise(0.0),
    )
    scored = pairs.withColumn("confidence", F.greatest(F.array_max(F.concat(by_abbr, F.array(F.lit(0.0)))), F.array_max(by_name)))
    best = scored.groupBy(header_col).agg(F.max(F.struct("confidence", (-F.col("pos")).alias("p"), "label", "kind")).alias("_b")).select(header_col, "_b.*")
    least = F.when(F.col("label").isin(*MAJOR), 0.90).otherwise(0.85)
    return best.where(F.col("confidence") >= least).select(header_col, "label", "kind", "confidence")


def label_columns(headers: DataFrame, header_col: str = "header") -> DataFrame:
    """Administrative labels first, then parties; distinct headers with a match."""
    spark = headers.sparkSession
    admin = match_labels(headers, admin_dictionary(spark), header_col, reversals=False)
    party = match_labels(headers.join(admin, header_col, "left_anti"), party_dictionary(spark), header_col)
    return admin.unionByName(party)


def resolve_columns(wanted: DataFrame, available: DataFrame) -> DataFrame:
    """(requested, name, rung): for each requested name the available column of the first rung that fits.

    Rungs: equal, equal without case and ends, equal in normal form, one normal form holds the other, most shared
    words; ties go to more words, then to the first position.  ``available`` has ``name, pos``, one small table.
    """
    req, name = F.col("requested"), F.col("name")
    a, b = column_normal_form(req), column_normal_form(name)
    shared = F.size(F.array_intersect(tokens(a), tokens(b)))
    rung = (
        F.when(req == name, 1)
        .when(F.lower(F.trim(req)) == F.lower(F.trim(name)), 2)
        .when(a == b, 3)
        .when((a != "") & (b != "") & (a.contains(b) | b.contains(a)), 4)
        .when(shared > 0, 5)
    )
    pairs = wanted.select("requested").distinct().join(_checked(available), F.lit(True)).withColumn("rung", rung).where("rung IS NOT NULL")
    order = W.partitionBy("requested").orderBy("rung", F.when(F.col("rung") == 5, -shared).otherwise(0), "pos")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("requested", "name", "rung")


def suggest_columns(wanted: DataFrame, available: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` columns that share most words with each requested name, with their rank."""
    shared = F.size(F.array_intersect(tokens(column_normal_form(F.col("requested"))), tokens(column_normal_form(F.col("name")))))
    pairs = wanted.select("requested").distinct().join(_checked(available), F.lit(True)).withColumn("shared", shared).where("shared > 0")
    order = W.partitionBy("requested").orderBy(F.desc("shared"), "pos")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("requested", "name", "shared", "rank")


def alliance_columns(headers: DataFrame, alliances: DataFrame) -> DataFrame:
    """Headers whose party is an ally, with its main party, by label and not by substring."""
    labels = match_labels(headers, party_dictionary(headers.sparkSession))
    found = labels.withColumn("ally", F.regexp_replace("label", " Votes$", ""))
    return found.join(_checked(alliances), "ally").select("header", "main", "ally", "confidence")
