import pytest
from pyspark.sql import functions as F

from tabloom.functions import reversal, text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (text.numeric, "1,234", 1234.0),
        (text.numeric, "O", None),
        (text.numeric, "", None),
        (text.numeric, "-", None),
        (text.numeric, "₹ 5", 5.0),
        (text.is_numeric_text, "-", True),
        (text.is_numeric_text, "1.2.3", False),
        (text.leading_number, "12 votes", 12.0),
        (text.leading_number, "votes", 0.0),
        (text.sanitize, "  NaN ", "NaN"),
        (text.sanitize, "None", ""),
        (text.sanitize, "a‎\nb\x01  c", "a b c"),
        (text.consonant_cluster, "BCDFGH", True),
        (text.consonant_cluster, "STRENGTH", True),
        (text.consonant_cluster, "AEIOU", False),
        (text.consonant_cluster, "CANDIDATE", False),
        (text.epic_normalize, "ABC12O4567", "ABC1204567"),
        (text.epic_normalize, "ABCXX34567", ""),
        (text.epic_fix, "SSLO0957704", "SSL0957704"),
        (text.epic_fix, "NNKT099068", "NNK1099068"),
        (text.epic_fix, "$SL1234567", "SSL1234567"),
        (text.epic_fix, "NNKA099068", "NNK4099068"),
        (text.house_digits, "l2", "12"),
        (text.house_digits, "O8", "08"),
        (text.house_digits, "1S3", "153"),
        (text.house_digits, "12B", "12B"),
        (text.house_digits, "3O", "30"),
        (text.house_digits, "15/B", "15/B"),
        (text.file_stem, "AC001-Name_modified", "Name"),
        (text.file_stem, "149_Ariyalur", "Ariyalur"),
        (text.file_stem, "Tiruppur_North", "Tiruppur_North"),
        (text.file_stem, "North_East", "East"),
        (text.file_stem, "", "data"),
        (text.booth_name, "P.U.M.S Thalavadi-638461 South Facing Terraced Building East Side", "P.U.M.S"),
        (text.booth_name, "P.U.M.School Thottagajanur-638461 East Facing", "P.U.M.School"),
        (text.booth_name, "PANCHAYAT UNION PRIMARY SCHOOL (ADDL. BUILDING), THENGUMARAHADA - 638451", "PANCHAYAT UNION PRIMARY SCHOOL"),
        (text.booth_name, "Govt. Boys Higher Secondary School Athani Road Sathyamangalam 638401East Facing", "Govt. Boys Higher Secondary School"),
        (text.ac_number, "AC no: 149", "149"),
        (text.ac_number, "Assembly number: 149", "149"),
        (text.ac_number, "No. & Name of the Assembly Constituency: 149 - Ariyalur", "149"),
        (text.ac_number, "nothing", None),
        (text.location_part, "Panchayat Union School [1] -North Street [2] -South Street", "Panchayat Union School"),
        (text.areas, "Panchayat Union School [2] -South Street [1] -North Street", ["[1] North Street", "[2] South Street"]),
        (text.numeric_cell_ocr, "1O5", "105"),
        (text.numeric_cell_ocr, "I2", "12"),
        (text.strip_titles, "Dr. A. Kumar", "A. Kumar"),
        (text.initials_first, "Selvaganapathi T M", "T M Selvaganapathi"),
        (text.fenced_json, "x ```json\n{\"a\": 1}\n``` y", '{"a": 1}'),
        (text.clean_address, "1. Main Road (12), Town PS No. 5", "Main Road , Town"),
        (text.column_normal_form, "Sl.-No_x", "SL NO X"),
        (text.tail_after_dash, "RAMAN - BJP", "BJP"),
        (text.gender, "Male", "M"),
        (text.gender, "xyz", "O"),
        (text.typed_number, "1,050", "1050"),
        (text.should_translate, "School building", True),
        (text.should_translate, "DMK", False),
        (text.should_translate, "12.5", False),
    ],
)
def test_scalars(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("t", ["KMD", "PJB", "ATON", "LATOT", "YTRAP", ".oN"])
def test_reversed(t):
    assert reversal.looks_reversed(t)


@pytest.mark.parametrize("t", ["DMK", "BJP", "NOTA", "TOTAL", "PARTY", "No."])
def test_not_reversed(t):
    assert not reversal.looks_reversed(t)


def test_repair(spark):
    df = spark.createDataFrame([("NOITATS GNILLOP",), ("POLLING STATION",), (None,)], "v string")
    got = [r[0] for r in df.select(reversal.repaired("v"), reversal.title_case(F.lit("K.R. NATARAJAN-x"))).collect()]
    assert got == ["POLLING STATION", "POLLING STATION", ""]
    assert df.limit(1).select(reversal.title_case(F.lit("K.R. NATARAJAN-x"))).first()[0] == "K.R. Natarajan-X"


def test_static_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([("  a ‮b\n c ",), ("null",), ("﻿x",)], "v string")
    once = df.select(text.sanitize(F.col("v")).alias("v"))
    assert once.collect() == once.select(text.sanitize(F.col("v")).alias("v")).collect()
