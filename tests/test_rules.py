import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import rules

CASES = [
    ("", "", "Top", True), ("", "", "a/b/C", True),
    ("com.example.*", "", "com/example/A", True), ("com.example.*", "", "com/example/x/A", True), ("com.example.*", "", "com/examples/A", False),
    ("*example", "", "org/exampletools/Service", True), ("*example", "", "org/myexample/Service", False),
    ("example*", "", "org/myexample/A", True), ("example*", "", "org/exampletools/A", False),
    ("*mpl*", "", "org/example/A", True), ("*mpl*", "", "mpl", False),
    ("*", "", "Top", True), ("**", "", "Top", False), ("**", "", "a/B", True),
    ("Service", "", "a/MyServiceImpl", True), ("Service", "", "a/b/Other", False), ("ex", "", "org/example/A", True),
    ("a.b", "", "a/b/C", True), ("a.b", "", "a/b/c/D", False), (".*", "", "Top", True),
    ("a?c", "", "abc/X", True), ("a?c", "", "abbc/X", False), ("a*c*e", "", "xabcde/X", False), ("a*c*e", "", "abcde/X", True),
    ("", "internal", "a/internal/X", False), ("*example", "internal", "org/example/internal/X", False), ("*example", "Secret", "org/example/SecretKey", False),
    ("x, y，z\nw", "", "w/A", True), ("x, y，z\nw", "", "v/A", False), ("a[b]*", "", "xa[b]/X", True), ("a[b]*", "", "a[b]c/X", False), ("a+b.*", "", "aab/X", False),
]


def test_truth_table_as_columns_and_in_readers(spark):
    df = spark.createDataFrame([(i, n) for i, (_, _, n, _) in enumerate(CASES)], "i int, name string").cache()
    for i, (allow, deny, name, expected) in enumerate(CASES):
        assert df.filter(f"i = {i}").select(rules.accepts(F.col("name"), allow, deny)).first()[0] is expected, CASES[i]
        assert rules.accepts_name(name, [rules.Rule(x) for x in rules.tokenize(allow)], [rules.Rule(x) for x in rules.tokenize(deny)]) is expected, CASES[i]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?.$+", min_size=1, max_size=6), st.text(alphabet="ab$+", max_size=5))
def test_globs_are_never_regular_expressions(pattern, text):
    import fnmatch
    import re

    assert bool(re.search(rules.glob(pattern), text)) == bool(re.fullmatch(fnmatch.translate(pattern.replace("[", "[[]")), text))


@pytest.mark.parametrize("name, bad", [("a/B", False), ("../B", True), ("a//B", True), ("a\\B", True), ("a:B", True), ("a;B", True), ("[B", True), ("a\0B", True), ("./B", True), ("包/类", False)])
def test_unsafe_names(spark, name, bad):
    assert rules.is_unsafe(name) is bad
    assert spark.createDataFrame([(name,)], "n string").select(rules.unsafe_name(F.col("n"))).first()[0] is bad


def test_null_name_is_not_accepted(spark):
    assert spark.createDataFrame([(None,)], "n string").select(rules.accepts(F.col("n"))).first()[0] is False
