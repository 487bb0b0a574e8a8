from pyspark.sql import functions as F

from quarry.functions import text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


def test_csv_cells_are_quoted_and_defused(spark):
    for raw, cell in [("a", '"a"'), ('a"b', '"a""b"'), ("=x", "\"'=x\""), ("  +x", "\"'  +x\""), ("\tx", "\"'\tx\""), ("x=1", '"x=1"'), ("", '""'), ("@a\nb", "\"'@a\nb\"")]:
        assert one(spark, text.csv_cell(F.col("v")), v=raw) == cell


def test_tsv_cells(spark):
    assert one(spark, text.tsv_cell(F.col("v")), v="a\\b\tc\nd\re") == "a\\\\b\\tc\\nd\\re"


def test_labels_and_roots(spark):
    label = text.source_label(F.col("v"), "/p")
    assert one(spark, label, v="/p/a/b.jar") == "a/b.jar"
    assert one(spark, label, v="/x/1/2/3/4/b.jar") == "external/2/3/4/b.jar"
    assert one(spark, label, v="/b.jar") == "external/b.jar"
    root = text.source_root(F.col("v"), F.col("r"), "/p")
    assert one(spark, root, v="/p/m/classes/a/B.class", r="a/B.class") == "/p/m/classes"
    assert one(spark, root, v="/p/m/xa/B.class", r="a/B.class") == "/p/m/xa"
    assert one(spark, root, v="/p/flat/renamed.class", r="a/B.class") == "/p/flat"


def test_names_are_safe_and_bounded(spark):
    assert one(spark, text.safe_name(F.col("v")), v="._a b/ü._") == "a_b_ü"
    assert one(spark, text.safe_name(F.col("v")), v="..__") == "project"
    assert one(spark, text.conflict_label(F.col("v")), v="") == "project"
    assert one(spark, text.conflict_label(F.col("v")), v="x" * 60) == "x" * 50
    assert one(spark, text.byte_bounded(F.col("v")), v="ü" * 100) == "ü" * 60
    assert one(spark, text.byte_bounded(F.col("v")), v="a" * 119 + "ü") == "a" * 119


def test_entries_stay_inside(spark):
    for entry, ok in [("a/b", True), ("../b", False), ("/a", False), ("a//b", False), ("a\\b", False), ("c:/b", False), ("", False), ("a/./b", False)]:
        assert one(spark, text.safe_entry(F.col("v")), v=entry) is ok
