import shutil
import subprocess

import pytest
from classes import make

from quarry.functions import classfile


def test_names_come_from_the_bytes():
    assert classfile.parse(make("a/b/C"))[:1] == ("a/b/C",)
    assert classfile.parse(make("示例包/示例"))[0] == "示例包/示例"


def test_nesting_is_read_not_guessed():
    assert classfile.enclosing_class(make("a/O$I", inner_of="a/O")) == "a/O"
    assert classfile.enclosing_class(make("a/O$1", enclosing="a/O")) == "a/O"
    assert classfile.enclosing_class(make("a/O$Standalone")) is None


def test_modified_utf8():
    assert classfile.modified_utf8("a😀".encode("utf-16", "surrogatepass") and b"a\xed\xa0\xbd\xed\xb8\x80") == "a😀"
    assert classfile.modified_utf8(b"a\xc0\x80b") == "a\0b"


@pytest.mark.parametrize("data", [b"", b"PK", make("a/B")[:20], make("../Escape"), make("a/B").replace(b"\x07", b"\x63", 1)])
def test_broken_classes_are_errors(data):
    name, parent, error = classfile.parse(data)
    assert name is None and parent is None and error


def test_broken_nesting_means_no_parent():
    data = make("a/O$1", enclosing="a/O")
    assert classfile.parse(data[:-3]) == ("a/O$1", None, None)  # the attribute's body is cut
    assert classfile.parse(data.replace(b"\0\0\0\x04", b"\0\0\0\x05")) == ("a/O$1", None, None)


def test_as_a_column(spark):
    df = spark.createDataFrame([(bytearray(make("a/O$I", inner_of="a/O")),), (bytearray(b"x"),), (None,)], "c binary")
    rows = [r[0] for r in df.select(classfile.parsed(df["c"])).collect()]
    assert (rows[0].name, rows[0].parent, rows[0].error) == ("a/O$I", "a/O", None)
    assert rows[1].name is None and rows[1].error and rows[2].error


@pytest.mark.skipif(not shutil.which("javac"), reason="needs javac")
def test_compiled_classes(tmp_path):
    (tmp_path / "Outer.java").write_text("package demo; public class Outer { long l = 5L; double d = 2.5; class Member { class Leaf {} } Object o = new Object() {}; void m() { class Local {} new Local(); Runnable r = () -> {}; } }")
    subprocess.run(["javac", "-d", str(tmp_path), str(tmp_path / "Outer.java")], check=True, timeout=120)
    got = {p.name: classfile.parse(p.read_bytes()) for p in (tmp_path / "demo").iterdir()}
    assert {k: v[1] for k, v in got.items()} == {"Outer.class": None, "Outer$Member.class": "demo/Outer", "Outer$Member$Leaf.class": "demo/Outer$Member", "Outer$1.class": "demo/Outer", "Outer$1Local.class": "demo/Outer"}
    assert all(v[0] == "demo/" + k.removesuffix(".class") for k, v in got.items())
