import pytest
from pyspark.sql import functions as F

from sluice.config import Limits
from sluice.functions import cells as c
from sluice.functions.rules import consent_rules
from sluice.operators.validate import reject_duplicates, row_errors, validate_rows

COLUMNS = consent_rules().columns
GOOD = {"Consent code": "C-1", "Consent name": "News", "Description": "d", "Purpose": "p", "Version": "1", "Status": "Active"}
CASES = [
    ({}, []),
    ({"Description": "", "Status": "ACTIVE"}, []),
    ({"Status": "inactive", "Version": "+1"}, []),
    ({"Consent code": ""}, ["Consent code is required"]),
    ({"Consent name": " \t "}, ["Consent name is required"]),
    ({"Purpose": ""}, ["Purpose is required"]),
    ({"Version": ""}, ["Version must be a positive whole number"]),
    ({"Version": "0"}, ["Version must be a positive whole number"]),
    ({"Version": "02"}, ["Version must be a positive whole number"]),
    ({"Version": "1.5"}, ["Version must be a positive whole number"]),
    ({"Version": "9223372036854775807"}, []),
    ({"Version": "9223372036854775808"}, ["Version must be a positive whole number"]),
    ({"Status": "unknown"}, ["Status must be one of: Active, Inactive"]),
    ({"Consent code": "ABCDEF"}, ["Consent code is longer than 5 characters"]),
    ({"Consent code": "😀😀😀😀😀"}, []),
    ({"Consent code": "\t ABCDE \n"}, []),
    ({"Consent code": "", "Purpose": "", "Status": "x"}, ["Consent code is required", "Purpose is required", "Status must be one of: Active, Inactive"]),
]


def test_consent_rules(spark):
    rules = consent_rules(Limits(code_chars=5))
    rows = [(i, list(COLUMNS), [(GOOD | change)[k] for k in COLUMNS]) for i, (change, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, header array<string>, cells array<string>")
    got = {r["i"]: r["e"] for r in df.select("i", row_errors(F.col("header"), F.col("cells"), rules).alias("e")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_header_in_another_order_and_extra_columns(spark):
    rules = consent_rules()
    header = ["extra", *(k.upper() for k in reversed(COLUMNS))]
    cells = ["?", *(GOOD[k] for k in reversed(COLUMNS))]
    df = spark.createDataFrame([("i", 1, 1, header, cells), ("i", 1, 2, header, cells[:2])], "import_id string, chunk_seq int, row_in_chunk long, header array<string>, cells array<string>")
    got = {r["row_in_chunk"]: r["errors"] for r in validate_rows(df, rules).collect()}
    assert got == {1: [], 2: ["has 2 cells but the header has 7"]}


def test_duplicates_point_at_the_first_valid_row_of_the_chunk(spark):
    rows = [(1, 1, "a", []), (1, 2, "a", ["bad"]), (1, 3, "a", []), (1, 4, "a", []), (1, 5, "b", []), (2, 1, "a", []), (1, 6, "c", ["bad"]), (1, 7, "c", [])]
    df = spark.createDataFrame(rows, "chunk_seq int, row_in_chunk long, k string, errors array<string>")
    got = {(r["chunk_seq"], r["row_in_chunk"]): r["errors"] for r in reject_duplicates(df, ["chunk_seq"], F.struct("k")).collect()}
    text = ["is a duplicate of row 1 of this chunk"]
    assert got == {(1, 1): [], (1, 2): ["bad"], (1, 3): text, (1, 4): text, (1, 5): [], (2, 1): [], (1, 6): ["bad"], (1, 7): []}


@pytest.mark.parametrize(
    ("size", "text"), [(0, "0 B"), (921, "921 B"), (922, "1 KB"), (1024, "1 KB"), (16 * 1024, "16 KB"), (512 * 2**20, "512 MB"), (943718, "922 KB"), (2**40, "1 TB")]
)
def test_file_size(spark, size, text):
    assert spark.range(1).select(c.file_size(F.lit(size)).alias("x")).first()["x"] == text


def test_names_and_messages(spark):
    df = spark.createDataFrame([("a.b.csv",), (".csv",), ("",), (None,), ("noext",), ("dir/x.csv",)], "name string")
    assert [r["d"] for r in df.select(c.download_name(F.col("name"), "result").alias("d")).collect()] == [
        "a.b-result.csv", "import-result.csv", "import-result.csv", "import-result.csv", "noext-result.csv", "x-result.csv",
    ]
    long = spark.createDataFrame([("x" * 1000,), ("y" * 999 + "  z",), (None,)], "m string").select(c.limited(F.col("m")).alias("m"))
    assert [r["m"] for r in long.collect()] == ["x" * 1000, "y" * 999 + "...", None]
