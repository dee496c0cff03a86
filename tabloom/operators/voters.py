"""Voters from lines: blocks that begin with a serial number, read line by line by a state machine.

A line is cut into labelled pieces; a fold over the pieces of a block keeps the first value of each field and the field
that is still open, to which lines without a label are added.  Everything is a Column expression over one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.house import clean_house_number
from tabloom.functions.text import clean_name, epic_fix, relation_type, squeeze, strip_zero_width

#: Fixed patterns of field labels, English and Tamil; earlier ones are found first, as a relative's label holds the word name.
LABELS = {
    "relative": r"(?:father|husband|mother)(?:'?s)?(?:\s*name)?|f/h\s*name|s/w/d\s*of|relation\s*name|தந்தை(?:யின்)?\s*பெயர்|கணவர்\s*பெயர்|தாயின்\s*பெயர்|இதரர்?\s*பெயர்",
    "name": r"(?:elector\s*)?name|பெயர்",
    "house": r"house\s*(?:no|number)\.?|h\.?\s*no\.?|வீட்டு\s*எண்",
    "age": r"age|வயது",
    "gender": r"gender|sex|பாலினம்",
}
#: Fixed pattern of what begins a block, and of an id.
SERIAL, EPIC = r"^\s*([0-9]{1,4})(?:\s|$)", r"(?<![A-Z])[A-Z]{3}[0-9]{7}(?![0-9])"
#: Fixed words for genders.
GENDERS = {"Female": r"female|பெண்|f", "Male": r"male|ஆண்|m", "Other": r"other|மூன்றாம்\s*பாலினம்|o"}
FIELDS = ("serial_no", "name", "father_husband_name", "relation_type", "house_no", "age", "gender", "voter_id")
_LETTER = r"a-zA-Z஀-௿"


def labelled_pieces(line: Column) -> Column:
    """array<struct<field, label, value>>: what a line holds before its first label (field empty) and after each label."""
    marked = epic_fix(strip_zero_width(F.coalesce(line, F.lit(""))))
    for field, label in LABELS.items():
        # a label that was found has lost its colon, so it is not found again
        marked = F.regexp_replace(marked, rf"(?i)(?<![{_LETTER}])({label})\s*[:=]\s*", f"\x01{field}\x03$1\x02")
    parts = F.split(marked, "\x01", -1)

    def piece(p: Column) -> Column:
        labelled = F.contains(p, F.lit("\x02"))
        head, value = F.substring_index(p, "\x02", 1), F.when(labelled, F.substring_index(p, "\x02", -1)).otherwise(p)
        return F.struct(
            F.when(labelled, F.substring_index(head, "\x03", 1)).otherwise("").alias("field"),
            F.when(labelled, F.substring_index(head, "\x03", -1)).otherwise("").alias("label"),
            squeeze(value).alias("value"),
        )

    return F.filter(F.transform(parts, piece), lambda p: (p["field"] != "") | (p["value"] != ""))


def _adult(text: Column) -> Column:
    """The first number from 18 to 100 that stands alone in a text, as text; empty without one."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9A-Za-z])[0-9]{1,3}(?![0-9A-Za-z])"), 0), lambda n: n.cast("int"))
    return F.coalesce(F.get(F.filter(numbers, lambda n: n.between(18, 100)), F.lit(0)).cast("string"), F.lit(""))


def _gender(text: Column) -> Column:
    out = F.lit("")
    for word, pattern in reversed(GENDERS.items()):
        out = F.when(text.rlike(rf"(?i)(?<![{_LETTER}])(?:{pattern})(?![{_LETTER}0-9])"), word).otherwise(out)
    return out


def parse_block(lines: Column, serial: Column | None = None) -> Column:
    """A struct of ``FIELDS`` (all strings) from a block's lines.

    Fields keep their first value.  A line without a label goes on with a name or relative's name that the line before left
    open; a line with an id or another label closes it.  A block with neither a name's nor a relative's label takes
    the first of its other lines, without id, gender and age, as the name, and age and gender wherever they stand;
    in labelled blocks they are looked for elsewhere only if their label is missing.  Ages outside 18 to 100 are
    left empty.  Null lines and arrays have empty fields.
    """
    texts = F.coalesce(lines, F.array().cast("array<string>"))
    pieces = F.flatten(F.transform(texts, labelled_pieces))
    empty = F.struct(*[F.lit("").alias(c) for c in ("name", "relative", "label", "house", "age", "gender", "epic", "loose", "open")])

    def step(acc: Column, p: Column) -> Column:
        field, value = p["field"], p["value"]
        epic = F.regexp_extract(value, EPIC, 0)
        plain = squeeze(F.regexp_replace(value, EPIC, " "))
        bare = field == ""
        goes_on = bare & acc["open"].isin("name", "relative") & (epic == "")

        def kept(name: str, kind: str) -> Column:
            new = F.when((field == kind) & (acc[name] == ""), plain).otherwise(acc[name])
            return F.when(goes_on & (acc["open"] == kind), F.concat_ws(" ", F.nullif(acc[name], F.lit("")), plain)).otherwise(new).alias(name)

        first = (field.isin("name") & (acc["name"] == "")) | ((field == "relative") & (acc["relative"] == ""))
        still = F.when(goes_on, acc["open"]).when(first & (epic == ""), field).otherwise("")
        return F.struct(
            kept("name", "name"),
            kept("relative", "relative"),
            F.when((field == "relative") & (acc["label"] == ""), p["label"]).otherwise(acc["label"]).alias("label"),
            F.when((field == "house") & (acc["house"] == ""), plain).otherwise(acc["house"]).alias("house"),
            F.when((field == "age") & (acc["age"] == ""), plain).otherwise(acc["age"]).alias("age"),
            F.when((field == "gender") & (acc["gender"] == ""), plain).otherwise(acc["gender"]).alias("gender"),
            F.when(acc["epic"] == "", epic).otherwise(acc["epic"]).alias("epic"),
            F.when(bare & ~goes_on & (acc["loose"] == ""), plain).otherwise(acc["loose"]).alias("loose"),
            still.alias("open"),
        )

    def told(acc: Column) -> Column:
        whole = F.array_join(F.transform(pieces, lambda p: p["value"]), " ")
        unlabelled = (acc["name"] == "") & (acc["relative"] == "")
        words = "|".join(GENDERS.values())
        loose = F.regexp_replace(acc["loose"], rf"(?i)(?<![{_LETTER}])(?:{words})(?![{_LETTER}0-9])|(?<![0-9A-Za-z])[0-9]{{1,3}}(?![0-9A-Za-z])", " ")
        name = clean_name(F.when(unlabelled, squeeze(loose)).otherwise(acc["name"]))
        return F.struct(
            (F.lit("") if serial is None else F.coalesce(serial, F.lit(""))).alias("serial_no"),
            name.alias("name"),
            clean_name(acc["relative"]).alias("father_husband_name"),
            F.coalesce(relation_type(acc["label"]), F.lit("")).alias("relation_type"),
            clean_house_number(acc["house"]).alias("house_no"),
            F.when(acc["age"] == "", _adult(F.regexp_replace(whole, EPIC, " "))).otherwise(_adult(acc["age"])).alias("age"),
            F.when(acc["gender"] == "", _gender(whole)).otherwise(_gender(acc["gender"])).alias("gender"),
            acc["epic"].alias("voter_id"),
        )

    return F.aggregate(pieces, empty, step, told)


def serial_blocks(lines: DataFrame, keys: Sequence[str] = ("doc_id", "page"), order: str = "line_no") -> DataFrame:
    """(keys, block, serial_no, lines): lines from one that begins with a serial number to the next; earlier lines are block 0.

    Empty lines are left out; the serial number is taken from its line.
    """
    serial = F.regexp_extract(F.coalesce("text", F.lit("")), SERIAL, 1)
    w = W.partitionBy(*keys).orderBy(order)
    marked = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_s", serial)
    marked = marked.withColumn("block", F.sum((F.col("_s") != "").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    rest = F.when(F.col("_s") != "", F.regexp_replace("text", SERIAL, "")).otherwise(F.col("text"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), rest.alias("t")))), lambda x: x["t"])
    return marked.groupBy(*keys, "block").agg(F.max("_s").alias("serial_no"), listed.alias("lines"))


def voters_from_lines(lines: DataFrame, keys: Sequence[str] = ("doc_id", "page"), order: str = "line_no") -> DataFrame:
    """(keys, block, fields): the voters of the blocks of each page; blocks without a name and without an id are none."""
    found = serial_blocks(lines, keys, order).withColumn("_v", parse_block(F.col("lines"), F.col("serial_no")))
    return found.select(*keys, "block", "_v.*").where("name <> '' OR voter_id <> ''")


def table_line_voter(line: Column) -> Column:
    """A struct of ``FIELDS`` from a line of columns parted by two spaces or tabs; null unless it has three, a serial number first.

    Id, age and gender are found in any column; what is left, in order, is name, relative's name and house number.
    """
    parts = F.filter(F.transform(F.split(F.trim(F.coalesce(line, F.lit(""))), r"\s{2,}|\t"), lambda p: F.trim(p)), lambda p: p != "")
    serial = F.regexp_extract(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), "^[0-9]{1,4}$", 0)

    def first(fold) -> Column:
        return F.coalesce(F.get(F.filter(F.transform(parts, fold), lambda x: x != ""), F.lit(0)), F.lit(""))

    epic, age, sex = first(lambda p: F.regexp_extract(p, EPIC, 0)), _adult(F.array_join(parts, " \n ")), first(_gender)
    genders = F.array(*map(F.lit, ("male", "female", "other", "m", "f", "o", "ஆண்", "பெண்", "மூன்றாம் பாலினம்")))
    rest = F.filter(F.slice(parts, 2, 100_000), lambda p: (p != epic) & (p != age) & ~F.array_contains(genders, F.lower(p)))
    at = [F.coalesce(F.get(rest, F.lit(i)), F.lit("")) for i in range(3)]
    values = (serial, clean_name(at[0]), clean_name(at[1]), F.lit(""), clean_house_number(at[2]), age, sex, epic)
    return F.when((serial != "") & (F.size(parts) >= 3), F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)]))
