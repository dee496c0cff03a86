"""Voter, roll and polling-list records from text segments, their filters and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.text import areas, clean_name, epic_fix, epics, gender, house_digits, location_part, relation_type, squeeze

#: Fixed words of summary and metadata cards.
SUMMARY = "(?i)\\b(total|summary|electors|male\\s*:|female\\s*:|net\\s+electors|supplement|amendment|deletions?\\s+list)\\b"
METADATA = "(?i)(assembly constituency|parliamentary|part\\s*(no|number)|section\\s*(no|name)|polling station|publication|qualifying date|page\\s+[0-9]+)"
DELETED = "(?i)\\bdeleted\\b|நீக்கப்பட்ட"
_TAMIL = "[\\u0B80-\\u0BFF]"


def _field(text: Column, label: str, value: str = "([^\\n:=]+)") -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, f"(?i)(?:{label})\\s*[:=]\\s*{value}", 1)), F.lit(""))


def voter(segment: Column) -> Column:
    """A struct of the voter's fields in a text segment; ages outside 18 to 100 are left empty."""
    text = epic_fix(segment)
    age = _field(text, "age|வயது", "([0-9]{1,3})").try_cast("int")
    relative = F.coalesce(_field(text, "father'?s?\\s*name|father"), _field(text, "husband'?s?\\s*name|husband"), _field(text, "mother'?s?\\s*name|mother|other"))
    own = _field(text, "(?<!father's )(?<!husband's )(?<!mother's )(?<![a-z] )\\bname|பெயர்")
    return F.struct(
        F.nullif(F.regexp_extract(text, "^\\s*([0-9]{1,5})\\b", 1), F.lit("")).alias("serial_no"),
        clean_name(F.coalesce(own, F.lit(""))).alias("name"),
        clean_name(F.coalesce(relative, F.lit(""))).alias("father_husband_name"),
        relation_type(text).alias("relation_type"),
        house_digits(F.coalesce(_field(text, "house\\s*(?:no|number)\\.?|house", "([^\\n:=]*?)(?=\\s*(?:age|photo|gender|$|\\n))"), F.lit(""))).alias("house_no"),
        F.when(age.between(18, 100), age.cast("string")).otherwise("").alias("age"),
        gender(F.coalesce(_field(text, "gender|sex|பாலினம்", "([\\p{L}]+)"), F.lit(""))).alias("gender"),
        F.coalesce(F.try_element_at(epics(text), F.lit(1)), F.lit("")).alias("voter_id"),
    )


def voters_from_segments(segments: DataFrame, text_col: str = "segment") -> DataFrame:
    keys = [c for c in segments.columns if c != text_col]
    return segments.withColumn("_v", voter(F.col(text_col))).select(*keys, "_v.*").where(is_valid())


def voters_from_table_line(line: Column) -> Column:
    """Fields of a line whose columns are parted by two spaces or tabs: serial, house, name, relative, age, gender, id."""
    f = F.split(F.trim(line), "\\s{2,}|\\t")
    return F.struct(*[F.coalesce(F.get(f, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("serial_no", "house_no", "name", "father_husband_name", "age", "gender", "voter_id"))])


def choose_strategy(candidates: DataFrame, order: list[str], share: float = 0.7) -> DataFrame:
    """For each page the first strategy, in order, at least ``share`` of whose voters have an id; else the one with most.

    ``candidates``: doc_id, page, strategy and voters' columns; the chosen strategy's voters are returned.
    """
    has_id = (F.coalesce("voter_id", F.lit("")) != "").cast("int")
    stats = candidates.groupBy("doc_id", "page", "strategy").agg(F.avg(has_id).alias("_s"), F.sum(has_id).alias("_n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    good = F.col("_s") >= share
    first = W.partitionBy("doc_id", "page").orderBy(F.when(good, 0).otherwise(1), F.when(good, rank).otherwise(-F.col("_n")), rank)
    chosen = stats.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("doc_id", "page", "strategy")
    return candidates.join(chosen, ["doc_id", "page", "strategy"])


def is_valid() -> Column:
    return (F.trim(F.coalesce("name", F.lit(""))) != "") | (F.trim(F.coalesce("voter_id", F.lit(""))) != "")


def is_deleted(text: Column) -> Column:
    return text.rlike(DELETED)


def is_header_card(text: Column) -> Column:
    """Furniture instead of a voter: metadata and no id, name or age of a voter."""
    return text.rlike(METADATA) & (F.size(epics(text)) == 0) & ~text.rlike("(?i)\\bage\\s*[:=]")


def has_voter_content(text: Column) -> Column:
    name, age, has_id = text.rlike("(?i)name\\s*[:=]|பெயர்"), text.rlike("(?i)age\\s*[:=]|வயது"), F.size(epics(text)) > 0
    tamil = F.length(text) - F.length(F.regexp_replace(text, _TAMIL, "")) >= 3
    return (name & age) | (name & has_id) | (has_id & age) | (name & tamil)


def is_false_voter() -> Column:
    """Records that are no voters; one with an id is always kept."""
    name = F.trim(F.coalesce("name", F.lit("")))
    evidence = sum(((F.trim(F.coalesce(c, F.lit(""))) != "").cast("int") for c in ("father_husband_name", "house_no", "age", "gender")), F.lit(0))
    return (F.coalesce("voter_id", F.lit("")) == "") & (name.rlike(SUMMARY) | name.rlike(METADATA) | (evidence < 1) | (F.length(name) < 2) | ~name.rlike("\\p{L}"))


def clean_voters(voters: DataFrame) -> DataFrame:
    """Leaked marks and metadata out of names, ids that stand as names moved away, empty records dropped."""
    name = squeeze(F.regexp_replace(F.coalesce("name", F.lit("")), "[\\[\\](){}]|(?i)photo\\s*(is)?\\s*available", ""))
    name = F.when(name.rlike("^[A-Z]{3}[0-9]{7}$") | name.rlike(METADATA) | name.rlike("^[^\\p{L}]*$"), "").otherwise(name)
    return voters.where(~is_false_voter()).withColumn("name", name).where(is_valid())


def fix_house_numbers(voters: DataFrame) -> DataFrame:
    """On pages where three house numbers or more end in a letter, and more than end in a digit after a digit, a last
    digit that a letter is read as becomes that letter."""
    page = W.partitionBy("doc_id", "page")
    h = F.trim(F.coalesce("house_no", F.lit("")))
    lettered, digits = F.count_if(h.rlike("^[0-9]+[A-Za-z]$")).over(page), F.count_if(h.rlike("^[0-9]{2,}$")).over(page)
    fixed = F.concat(F.regexp_extract(h, "^(.*).$", 1), F.translate(F.substring(h, -1, 1), "84", "BA"))
    apply_ = (F.col("_l") >= 3) & (F.col("_l") > F.col("_d")) & h.rlike("^[0-9]+[84]$")
    marked = voters.withColumn("_l", lettered).withColumn("_d", digits)
    return marked.withColumn("house_no", F.when(apply_, fixed).otherwise(F.col("house_no"))).drop("_l", "_d")


def roll_header(text: Column) -> Column:
    """Constituency, part, address and stated voters of a roll's first page."""
    return F.struct(
        F.regexp_extract(text, "(?i)assembly\\s+constituency[^0-9]*([0-9]{1,3})", 1).alias("ac_no"),
        F.regexp_extract(text, "(?i)part\\s*(?:no|number)\\.?\\s*[:=]?\\s*([0-9]{1,4})", 1).alias("part_no"),
        squeeze(F.regexp_extract(text, "(?i)address\\s+of\\s+polling\\s+station\\s*[:=]?\\s*([^\\n]+)", 1)).alias("address"),
        F.regexp_extract(text, "(?i)(?:total|net)\\s+(?:voters|electors)\\s*[:=]?\\s*([0-9]+)", 1).alias("total_voters"),
    )


def section_name(text: Column) -> Column:
    return squeeze(F.regexp_extract(text, "(?i)section\\s*(?:no\\.?\\s*(?:and|&)\\s*)?name\\s*[:=]?\\s*(?:[0-9]+\\s*[-.]\\s*)?([^\\n]+)", 1))


def with_section(voters: DataFrame, pages: DataFrame) -> DataFrame:
    """The page's section name on each of its voters."""
    sections = pages.select("doc_id", "page", section_name(F.col("text")).alias("street_name"))
    return voters.drop("street_name").join(sections, ["doc_id", "page"], "left")


def polling_row(cells: Column) -> Column:
    """Serial, id, location, areas and type of a polling list's row."""
    def at(i: int) -> Column:
        return F.trim(F.coalesce(F.get(cells, F.lit(i)), F.lit("")))

    text = F.array_join(F.slice(cells, 3, F.greatest(F.size(cells), F.lit(0))), " ")
    return F.struct(
        at(0).try_cast("int").alias("serial_num"), F.regexp_extract(at(1), "([0-9]+)", 1).try_cast("int").alias("id_num"),
        location_part(text).alias("location"), areas(text).alias("areas"), F.array_join(areas(text), " | ").alias("areas_text"),
        F.when(F.upper(text).rlike("\\bALL VOTERS\\b"), "All Voters").when(F.upper(text).rlike("\\bMEN\\b"), "Men").when(F.upper(text).rlike("\\bWOMEN\\b"), "Women").otherwise("").alias("station_type"),
    )


def renumber(voters: DataFrame) -> DataFrame:
    """Serials from 1 in page order within each document."""
    return voters.withColumn("serial_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page", "pos")).cast("string"))
