"""House numbers: digits that were read as letters, noise around numbers, and several numbers in one line.

A letter is judged by where it stands: in which part of the number, and what stands before and after it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed letters that stand for digits inside a number, and the digits.
LOOK_ALIKE, DIGITS = "OoQlIi|ZzSsBbGgDT", "00011112255886607"
#: Fixed letters that are digits even at the end of a number.
NO_SUFFIX = "OISZT"
#: Fixed Tamil letters for parts of a house, as (letter, Latin letter).
PARTS = (
    ("அ", "A"), ("ஆ", "A"), ("ஏ", "A"), ("பி", "B"), ("பீ", "B"), ("சி", "C"), ("சீ", "C"), ("டி", "D"), ("டீ", "D"),
    ("இ", "E"), ("எஃப்", "F"), ("ஜி", "G"), ("எச்", "H"), ("ஐ", "I"), ("ஜே", "J"), ("ஜெ", "J"), ("கே", "K"), ("கெ", "K"),
    ("எல்", "L"), ("எம்", "M"), ("என்", "N"),
)
_TAMIL = r"[஀-௿]"


def look_alike_digits(number: Column) -> Column:
    """``l2`` is 12, ``O8/l9l`` 08/191, ``1S3`` 153; ``12B`` and ``15/B`` keep their letter, ``3O`` is 30.

    Parts stand between ``-`` and ``/``.  A single letter after a separator stays; so does a capital at the end of the last
    part behind a digit or look-alike, unless it is one that is always a digit.  Look-alikes elsewhere become digits.
    """
    parts = F.regexp_extract_all(number, F.lit("[-/]|[^-/]+"), 0)

    def fixed(part: Column, at: Column) -> Column:
        digits = F.translate(part, LOOK_ALIKE, DIGITS)
        before = F.substring(part, F.lit(1), F.char_length(part) - 1)
        suffix = (at == F.size(parts) - 1) & part.rlike("[A-Z]$") & ~part.rlike(f"[{NO_SUFFIX}]$") & before.rlike(f"[0-9{LOOK_ALIKE}]")
        single = (at > 0) & part.rlike(r"^\p{L}$")
        return F.when(part.isin("-", "/") | single, part).when(suffix, F.concat(F.translate(before, LOOK_ALIKE, DIGITS), F.right(part, F.lit(1)))).otherwise(digits)

    return F.array_join(F.transform(parts, fixed), "")


def clean_house_number(raw: Column) -> Column:
    """A house number without noise: label remains, stray marks and letters, words after it; empty if no digit is left.

    ``15 _- -`` and ``15 - Photo 6`` are 15, ``15 அ`` is 15A, ``36&`` is 36A, ``4671 STREET`` is 4671, ``16J,SWETHAN`` is 16J.
    Leading zeros go only where the whole is a number.  Null is empty.
    """
    h = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$|[ .,;:]+$", "")
    h = F.regexp_replace(h, r"^0+([0-9]+)$", "$1")
    h = F.regexp_replace(h, r"^[;:!@#$%^*+=]+", "")
    h = F.trim(F.regexp_replace(h, r"(?i)\s*Photo\s+is.*$|\s*Photo\s*[0-9]*\s*$", ""))
    h = F.trim(F.replace(F.regexp_replace(h, r"^எண்\s*\.?\s*", ""), F.lit("&"), F.lit("A")))
    # longer letters first, as shorter ones are their beginnings
    for letter, latin in sorted(PARTS, key=lambda p: -len(p[0])):
        h = F.regexp_replace(h, rf"\s*{letter}", latin)
    h = F.regexp_replace(h, rf"\s+{_TAMIL}(?:\s|$)", "")
    h = F.regexp_replace(h, r"[\s_.;\-]+$|^[\s_.]+", "")
    h = F.regexp_replace(h, r"^-+(?![0-9])", "")
    # words go before letters are read as digits, so that none is left as half a number
    h = F.trim(F.regexp_replace(h, rf"\s+[A-Za-z]{{3,}}.*$|,[A-Za-z]{{3,}}.*$|,{_TAMIL}{{2,}}.*$", ""))
    h = F.when(h.rlike(f"[0-9{LOOK_ALIKE}]"), look_alike_digits(h)).otherwise("")
    return F.when((F.char_length(h) <= 20) & h.rlike("[0-9]"), h).otherwise("")


def house_numbers(line: Column) -> Column:
    """array<string>: the numbers after each house label of a line, first those of right labels, then those of garbled ones.

    A number after a garbled label may have taken digits from what follows; it is cut to the length of the longest
    number after a right label, if there is one.
    """
    number = r"\s*:?\s*([0-9][\w/\-&.]*)"
    text = F.coalesce(line, F.lit(""))

    def found(label: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?:{label}){number}"), 1), lambda h: F.regexp_replace(F.replace(h, F.lit("&"), F.lit("A")), "[.,;: ]+$", ""))

    right = found(r"(?:வீட்டு|ட்டு)\s*எண்|House\s*No\.?")
    garbled = found(r"[A-Z]{2,4}\)\s*[a-z]*(?:evor|revor|rovor)")
    longest = F.array_max(F.transform(right, F.char_length))
    return F.concat(right, F.transform(garbled, lambda g: F.when(longest.isNull(), g).otherwise(F.substring(g, F.lit(1), F.coalesce(longest, F.lit(0))))))
