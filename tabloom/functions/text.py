"""Cleaning and parsing of table text as Column expressions, all of them evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bidirectional controls, byte order mark; words that stand for no value.
BIDI = "[\\u202A-\\u202E\\u200E\\u200F\\u2066-\\u2069\\uFEFF]"
NO_VALUE = ("nan", "none", "null", "undefined")
_SPACE = "(?U)\\s+"


def squeeze(text: Column) -> Column:
    """Runs of any white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def sanitize(text: Column) -> Column:
    """Static cleaning: words for no value to empty; direction marks, controls and replacement characters out; squeezed."""
    t = F.coalesce(text, F.lit(""))
    cleaned = F.regexp_replace(F.regexp_replace(t, BIDI, ""), "[\\x00-\\x08\\x0B-\\x1F\\uFFFD]", "")
    return F.when(F.lower(t).isin(*NO_VALUE), "").otherwise(squeeze(cleaned))


def numeric(text: Column, symbols: str = ", ₹") -> Column:
    """The number in a cell without separators and currency signs; null where there is none."""
    plain = F.regexp_replace(F.trim(text), f"[{symbols}]", "")
    return F.when(plain.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def is_numeric_text(text: Column) -> Column:
    """Digits with separators, one sign and one point at most; a lone ``-`` counts."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[, ]", "")
    return (F.coalesce(text, F.lit("")) != "") & plain.rlike("^-?[0-9]*\\.?[0-9]*$")


def leading_number(text: Column) -> Column:
    """The number that a cell begins with, commas removed; 0 where there is none."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(""))
    return F.coalesce(F.regexp_extract(plain, "^\\s*([-+]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+))", 1).try_cast("double"), F.lit(0.0))


def consonant_cluster(text: Column) -> Column:
    """Four consonants in a row once everything but letters is gone; Y is a consonant here."""
    return F.regexp_replace(F.upper(text), "[^\\p{L}]", "").rlike("[B-DF-HJ-NP-TV-Z]{4}")


def column_normal_form(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.upper(name), "-_.", "  "), "\\s+", " "))


def match_form(text: Column) -> Column:
    """Upper case, everything but letters, digits and spaces to spaces, squeezed."""
    return squeeze(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9\\s]", " "))


def reverse_words(text: Column) -> Column:
    return F.array_join(F.reverse(F.split(text, " ")), " ")


def reverse_each_word(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.reverse(w)), " ")


def reversal_forms(text: Column) -> Column:
    """A text and its four reversals: words, letters of each word, all letters, and words with their letters."""
    return F.array_distinct(
        F.array(text, reverse_words(text), reverse_each_word(text), F.reverse(text), reverse_each_word(reverse_words(text)))
    )


def tail_after_dash(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "[-–—]"), -1))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "\\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Fixed OCR confusions of letters for digits.
EPIC_FROM, EPIC_TO = "OIlASGBZb", "011456820"
FOURTH_FROM, FOURTH_TO = "OoIlTtASGBZb", "001111456820"


def epic_normalize(raw: Column) -> Column:
    """Three letters and seven digits after letter-for-digit repair, else empty."""
    fixed = F.concat(F.substring(raw, 1, 3), F.translate(F.substring(raw, 4, 1000), EPIC_FROM, EPIC_TO))
    return F.when(fixed.rlike("^.{3}[0-9]+$"), fixed).otherwise("")


def epic_fix(text: Column) -> Column:
    """``$`` to S, runs of S to two, a doubled O dropped, and a fourth letter that is a digit repaired."""
    t = F.replace(text, F.lit("$"), F.lit("S"))
    t = F.regexp_replace(t, "S{2,}([A-Z][0-9]{7})", "SS$1")
    t = F.regexp_replace(t, "([A-Z]{3})[Oo]([0-9]{7})\\b", "$1$2")
    for a, b in zip(FOURTH_FROM, FOURTH_TO, strict=True):
        t = F.regexp_replace(t, f"([A-Z]{{3}}){a}([0-9]{{6}})\\b", f"${{1}}{b}$2".replace("${1}", "$1"))
    return t


def epics(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?<![A-Z])([A-Z]{3}[0-9]{7})(?![0-9])"), F.lit(1))


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, "[\\u200B-\\u200D\\u2060\\uFEFF]", "")


def relation_type(text: Column) -> Column:
    """F (father) or H (husband) by the relation label; null without one."""
    low = F.lower(text)
    return F.when(low.rlike("husband|கணவர்"), "H").when(low.rlike("father|mother|other|தந்தை|தாய்"), "F")


def gender(text: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(low == "", "").when(low.isin("m", "male", "ஆண்"), "M").when(low.isin("f", "female", "பெண்"), "F").otherwise("O")
    )


def clean_name(name: Column) -> Column:
    t = F.regexp_replace(strip_zero_width(name), "^[\\s:=\\-.]+|[\\s:=\\-|]+$", "")
    return squeeze(F.regexp_replace(t, "[\\[\\]{}|]", ""))


def house_digits(text: Column) -> Column:
    """In tokens of digits and look-alikes, look-alikes between or beside digits become digits: l I to 1, O o to 0,
    and S to 5 between digits."""
    t = F.regexp_replace(text, "(?<=[0-9])S(?=[0-9])", "5")
    for _ in range(2):
        t = F.regexp_replace(t, "(?<=[0-9])[lI](?![A-Za-z])|(?<![A-Za-z])[lI](?=[0-9])", "1")
        t = F.regexp_replace(t, "(?<=[0-9])[Oo](?![A-Za-z])|(?<![A-Za-z])[Oo](?=[0-9])", "0")
    return t


def file_stem(name: Column) -> Column:
    """Drop ``_modified`` and a short code before the first ``-`` or ``_``; empty names become ``data``."""
    t = F.regexp_replace(F.coalesce(name, F.lit("")), "(?i)_modified$", "")
    rest = F.regexp_extract(t, "^[A-Za-z0-9]{1,6}[-_]\\s*(.+)$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", "data").when(rest != "", rest).otherwise(t)


def safe_file_name(name: Column) -> Column:
    return F.substring(F.translate(name, '/\\<>:"|?*\x00', "_________"), 1, 255)


def size_text(size: Column) -> Column:
    out = F.concat(F.format_string("%.1f", size / F.lit(1024.0**4)), F.lit(" TB"))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", size / F.lit(1024.0**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def sheet_name(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[\\[\\]:*?/\\\\]", "_"), 1, 31)


#: Fixed words of institutions and of descriptors in parentheses.
INSTITUTIONS = "School|College|Hall|Office|Centre|Center|Library|Hospital|Temple|Mandapam|Polytechnic|University|Institute|Anganwadi"
DESCRIPTORS = "ADDL|ADDITIONAL|BUILDING|NORTH|SOUTH|EAST|WEST|MAIN|NEW|OLD|FACING|PORTION|WING|SIDE|LEFT|RIGHT|BLOCK|ROOM|MIDDLE|TERRACED|TILED"


def booth_name(source: Column) -> Column:
    """The institution in a booth's location: before the first comma, without pin codes and trailing descriptors."""
    t = F.trim(F.element_at(F.split(F.trim(F.coalesce(source, F.lit(""))), ","), 1))
    t = F.regexp_replace(F.regexp_replace(t, "[-\\u2013]\\s*[0-9]{6}", ""), "\\b[0-9]{6}(?=[A-Za-z\\s]|$)", "")
    t = squeeze(t)
    t = F.when(t.rlike(f"(?i)\\([^)]*\\b({DESCRIPTORS})\\b[^)]*\\)\\s*$"), F.trim(F.regexp_replace(t, "\\s*\\([^)]+\\)\\s*$", ""))).otherwise(t)
    whole = F.regexp_extract(t, f"(?i)^(.*?(?<![A-Za-z.])(?:{INSTITUTIONS}))\\b", 1)
    short = F.regexp_extract(t, "^((?:[A-Za-z]{1,2}\\.){2,}[A-Za-z]*)", 1)
    return F.when(whole != "", F.trim(whole)).when(short != "", short).otherwise(t)


def clean_address(address: Column) -> Column:
    t = squeeze(F.coalesce(address, F.lit("")))
    for noise in (
        "\\bPS\\s*No\\.?\\s*[0-9]+\\b", "\\bBooth\\s*No\\.?\\s*[0-9]+\\b", "\\bSlNo\\.?\\s*[0-9]+\\b",
        "\\bS\\.?No\\.?\\s*[0-9]+\\b", "^[0-9]+\\s*[-.]\\s*", "\\(\\s*[0-9]+\\s*\\)",
    ):
        t = F.regexp_replace(t, "(?i)" + noise, "")
    return F.btrim(squeeze(t), F.lit(" ,-."))


#: Fixed ways in which a page names its assembly constituency's number, in order of trust.
AC_PATTERNS = (
    "(?:no\\.?\\s*&?\\s*name\\s+of\\s+the\\s+)?assembly\\s+constituency[:\\s]+([0-9]+)",
    "ac\\s+no\\.?\\s*:?\\s*([0-9]+)",
    "assembly\\s+number[:\\s]+([0-9]+)",
    "no\\.?\\s+of\\s+assembly\\s+constituency[:\\s]+([0-9]+)",
    "assembly\\s+constituency\\s+no\\.?\\s*:?\\s*([0-9]+)",
    "constituency\\s+no\\.?\\s*:?\\s*([0-9]+)",
    "no\\.?\\s*&?\\s*name\\s+of\\s+the\\s+assembly\\s+constituency[:\\s]+([0-9]+)",
)


def ac_number(page_text: Column) -> Column:
    """The constituency number a page states, else a number of 1-300 near the word; null without one."""
    found = [F.nullif(F.regexp_extract(page_text, "(?i)" + p, 1), F.lit("")) for p in AC_PATTERNS]
    near = F.regexp_extract(page_text, "(?i)constituency[^0-9]{0,40}([0-9]{1,3})\\b", 1)
    return F.coalesce(*found, F.when(near.try_cast("int").between(1, 300), near))


def numeric_cell_ocr(cell: Column) -> Column:
    """Letters that stand for digits become digits."""
    return F.translate(cell, "OoIlSBZG", "00115826")


def entry_number(raw: Column, glued: Column) -> Column:
    """A doubled digit (11 to 99) is one digit only where the two numbers were printed without a gap."""
    return F.when(glued & raw.rlike("^([1-9])\\1$"), F.substring(raw, 1, 1)).otherwise(raw).try_cast("int")


def location_part(text: Column) -> Column:
    """What stands before the first ``[n]``."""
    return squeeze(F.element_at(F.split(text, "\\[[0-9]+\\]"), 1))


def areas(text: Column) -> Column:
    """``[1] North Street | [2] South Street``: the numbered areas, distinct, by number."""
    found = F.regexp_extract_all(text, F.lit("(\\[[0-9]+\\]\\s*-?\\s*[^\\[]+)"), F.lit(1))
    parts = F.transform(
        found,
        lambda a: F.struct(
            F.regexp_extract(a, "\\[([0-9]+)\\]", 1).try_cast("int").alias("n"),
            F.btrim(squeeze(F.regexp_extract(a, "\\]\\s*-?\\s*(.*)$", 1)), F.lit(" ,;|")).alias("t"),
        ),
    )
    return F.transform(F.array_sort(F.array_distinct(parts)), lambda p: F.format_string("[%d] %s", p["n"], p["t"]))


#: Fixed titles before and after names.
TITLES = "dr|mr|mrs|ms|prof|professor|adv|advocate|hon|honourable|shri|smt"


def strip_titles(name: Column) -> Column:
    t = F.regexp_replace(name, f"(?i)^(?:(?:{TITLES})\\.*(?:\\s+|$))+", "")
    return F.trim(F.regexp_replace(t, f"(?i)(?:(?:^|\\s+)(?:{TITLES})\\.*)+$", ""))


def initials_first(name: Column) -> Column:
    words = F.filter(F.split(name, "\\s+"), lambda w: w != "")

    def short(w: Column) -> Column:
        return F.length(F.replace(w, F.lit("."), F.lit(""))) <= 1

    return F.array_join(F.concat(F.filter(words, short), F.filter(words, lambda w: ~short(w))), " ")


def party_in_cell(cell: Column) -> Column:
    """The party in a header cell: in its last parentheses, or a short capital word of its own."""
    inside = F.regexp_extract(cell, "\\(([^()]+(?:\\([A-Z]\\))?)\\)\\s*$", 1)
    alone = F.regexp_extract(cell, "^\\s*([A-Z]{2,8}(?:\\([A-Z]\\))?)\\s*$", 1)
    return F.when(inside != "", F.trim(inside)).when(alone != "", alone)


def party_normal_form(name: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.upper(name), "\\bVOTES?\\b", ""), "[.]", ""))


def script_share(text: Column, script: str = "[\\u0B80-\\u0BFF]") -> Column:
    """The share of a text's letters and marks that lie in a script; 0 without any."""
    letters = F.regexp_replace(text, "[^\\p{L}\\p{M}]", "")
    own = F.length(letters) - F.length(F.regexp_replace(letters, script, ""))
    return F.when(F.length(letters) > 0, own / F.length(letters)).otherwise(0.0)


def fenced_json(text: Column) -> Column:
    """The JSON text in a fenced block, else from the first brace to the last."""
    block = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)```", 1)
    braces = F.regexp_extract(text, "(?s)([\\[{].*[\\]}])", 1)
    return F.when(block != "", F.btrim(block, F.lit(" \n\r\t"))).when(braces != "", braces)


def cache_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("\x1f", *parts))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def should_translate(text: Column, script: str = "[\\u0B80-\\u0BFF]") -> Column:
    """Texts with letters that are neither codes, numbers, party names nor already in the target script."""
    t = F.trim(F.coalesce(text, F.lit("")))
    fixed = any_of(t, ("^[0-9.,/\\-\\s%]*$", "^[A-Z]{2,8}(\\([A-Z]\\))?$", "^[A-Z]{3}[0-9]{7}$", "^(https?://|www\\.)"))
    return t.rlike("\\p{L}") & ~fixed & (script_share(t, script) <= 0.8)


def typed_number(cell: Column) -> Column:
    """What a sheet writes for a cell: a number without commas, whole ones without a point, else the text."""
    n = numeric(cell, ",")
    return F.when(n.isNull(), cell).when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))
