import pytest
from pyspark.sql import functions as F

from kolophon.functions import text as T

ROWS = [
    (None, "", "", ""),
    ("Ἀρχή, τέλος·", "αρχη τελος", "αρχη τελος", "ἀρχή, τέλος·"),
    ("ΛΟΓΟΣ", "λογος", "λογος", "λογος"),
    ("α[lost]β", "α lost β", "α β", "α[lost]β"),
    ("α(β)γ{δ}", "αβγδ", "α β γ", "α(β)γ{δ}"),
    ("a...b--c", "a b c", "a b c", "a...b--c"),
    ("x_y  z", "x_y z", "x_y z", "x_y z"),
]


def test_normalisers(spark):
    df = spark.createDataFrame([(r[0],) for r in ROWS], "t string")
    c = F.col("t")
    got = df.select(T.normalize_v1(c), T.normalize_v2(c), T.normalize_v1(c, punctuation=False, diacritics=False)).collect()
    for row, want in zip(got, ROWS, strict=True):
        assert tuple(row) == want[1:]


def test_v3_composes(spark):
    df = spark.createDataFrame([("ﬁn ½",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_v3(F.col("t"))).collect()] == ["fin 1 2", ""]


def test_exact_diacritics(spark):
    df = spark.createDataFrame([("é한",)], "t string")
    native, exact = df.select(T.strip_diacritics(F.col("t")), T.strip_diacritics(F.col("t"), exact=True)).first()
    assert native == "e한" and len(exact) > 2


@pytest.mark.parametrize(("text", "k", "want"), [("abcd", 2, ["ab", "bc", "cd"]), ("ab", 4, ["ab"]), ("", 3, [""])])
def test_shingles(spark, text, k, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.shingles(F.col("t"), k)).first()[0] == want


def test_counts_and_scripts(spark):
    df = spark.createDataFrame([("λογος θεος",), ("αβ",), ("λογος 12",), ("λογος abc",), ("   ",), ("",)], "t string")
    got = df.select(T.is_script(F.col("t"), "greek"), T.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False]
    assert [r[1] for r in got] == [2, 1, 2, 2, 0, 0]
