import io
import os
import zipfile

import pytest
from classes import jar, make, put

from quarry.operators import engine, report
from quarry.plans import control, export
from quarry.sources import artifacts, sinks
from quarry.sources.contents import Changed, Contents


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


def test_scan_reads_loose_nested_and_hidden_but_no_links(spark, tmp_path):
    put(tmp_path, "lib/.cache/B.class", make("demo/B"))
    put(tmp_path, "lib/_C.CLASS", make("demo/C"))
    put(tmp_path, "lib/.git/D.class", make("demo/D"))
    put(tmp_path, "lib/a.jar", jar({"x/E.class": make("demo/E"), "inner.jar": jar({"F.class": make("demo/F")}), "../../g.class": make("demo/G"), "bad.class": b"no"}))
    os.symlink(tmp_path / "lib/_C.CLASS", tmp_path / "lib/link.class")
    os.symlink(tmp_path / "lib", tmp_path / "lib/loop")
    rows = {r.origin: r for r in artifacts.scan(spark, [str(tmp_path / "lib"), str(tmp_path / "lib/a.jar")], project=str(tmp_path)).collect()}
    assert {r.name for r in rows.values() if r.status == "ok"} == {"demo/B", "demo/C", "demo/E", "demo/F", "demo/G"}
    assert rows["lib/a.jar!/inner.jar!/F.class"].grp == "lib/a.jar!/inner.jar"
    assert rows["lib/a.jar!/bad.class"].status == "error"


def test_filtered_classes_are_not_read(tmp_path):
    data = make("demo/Big", trailer=b"\0" * 2_000_000)
    for deny, less in (("demo", True), ("", False)):
        stream = artifacts.Counted(io.BytesIO(data))
        got = artifacts.read_class(stream, [], [artifacts.Rule(x) for x in artifacts.tokenize(deny)])
        assert (stream.total < len(data) / 2) is less and (got[4] == "filtered") is less


def test_depth_limit(spark, tmp_path):
    data = jar({"A.class": make("demo/A")})
    for _ in range(9):
        data = jar({"n.jar": data})
    put(tmp_path, "deep.jar", data)
    assert [r.status for r in artifacts.scan(spark, [str(tmp_path / "deep.jar")]).collect()] == ["warning"]
    inner = data
    inner = zipfile.ZipFile(io.BytesIO(inner)).read("n.jar")
    put(tmp_path, "less.jar", inner)
    assert [r.name for r in artifacts.scan(spark, [str(tmp_path / "less.jar")]).collect()] == ["demo/A"]


def test_versions_survive_and_copies_go(spark, tmp_path):
    for name, body in (("a", b"1"), ("b", b"2"), ("copy", b"1")):
        put(tmp_path, f"{name}.jar", jar({"demo/Same.class": make("demo/Same", body=body)}))
    r = export.export_classes(spark, [str(tmp_path / f"{n}.jar") for n in ("a", "b", "copy")], str(tmp_path / "out"), project=str(tmp_path))
    assert (r.discovered, r.exported, r.duplicates) == (3, 2, 1)
    got = [f for f in files(tmp_path / "out") if f.endswith(".class")]
    assert len(got) == 2 and all(f.startswith("classes-conflicts/") and f.endswith("/demo/Same.class") for f in got)


def test_folder_and_zip_hold_the_same(spark, tmp_path):
    put(tmp_path, "l/A.class", make("demo/A"))
    put(tmp_path, "l/B.class", make("demo/b"))
    put(tmp_path, "l/sub/B.class", make("demo/B"))
    put(tmp_path, "l/X.class", make("demo/secret/X"))
    args = dict(deny="secret", project=str(tmp_path))
    a = export.export_classes(spark, [str(tmp_path / "l")], str(tmp_path / "d"), **args)
    b = export.export_classes(spark, [str(tmp_path / "l")], str(tmp_path / "z.zip"), format="zip", **args)
    assert (a.filtered, a.exported) == (1, 3) and a == b
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert {n: z.read(n) for n in z.namelist()} == files(tmp_path / "d")
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".parts")]
    with pytest.raises(Exception, match="exists"):
        export.export_classes(spark, [str(tmp_path / "l")], str(tmp_path / "d"), **args)


def test_no_libraries_touch_nothing(spark, tmp_path):
    with pytest.raises(ValueError):
        export.export_classes(spark, [], str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def failing(members):
    if any("Bad" in m.name for m in members):
        raise OSError("=broken, \"quoted\"\nline") from ValueError("inner")
    extra = "\n// $FF: Couldn't be decompiled\n" if "Part" in members[0].name else ""
    return engine.Output('String s = "// $FF: Couldn\'t be decompiled";' + extra + ",".join(m.name for m in members), ["note"] if "Warn" in members[0].name else [])


def test_families_are_transformed_once_with_reports(spark, tmp_path):
    put(tmp_path, "l/O.class", make("demo/Outer"))
    put(tmp_path, "l/OI.class", make("demo/Outer$I", inner_of="demo/Outer"))
    put(tmp_path, "l/OIJ.class", make("demo/Outer$I$J", inner_of="demo/Outer$I"))
    put(tmp_path, "l/S.class", make("demo/Outer$Standalone"))
    put(tmp_path, "l/Bad.class", make("demo/Bad"))
    put(tmp_path, "l/BadI.class", make("demo/Bad$I", inner_of="demo/Bad"))
    put(tmp_path, "l/Part.class", make("demo/Part"))
    put(tmp_path, "l/Warn.class", make("demo/Warn"))
    r = export.export_families(spark, [str(tmp_path / "l")], str(tmp_path / "out"), engine.Engine(failing), project=str(tmp_path))
    got = files(tmp_path / "out")
    assert got["demo/Outer.java"].decode().endswith("demo/Outer,demo/Outer$I,demo/Outer$I$J")
    assert {"demo/Outer$Standalone.java", "demo/Part.java", "demo/Warn.java"} <= set(got) and "demo/Bad.java" not in got
    assert (r.exported, r.partially_exported, r.failed_rows, r.successfully_exported) == (4, 1, 3, 3)
    csv = got["decompilation-failures.csv"].decode()
    assert csv.startswith("﻿") and csv.count("\r\n") == 4 and 'demo.Bad$I' in csv and '""quoted""' in csv
    assert len(got["export-sources.tsv"].decode().splitlines()) == 1 + 6


def test_a_denied_inner_class_cannot_leak(spark, tmp_path):
    put(tmp_path, "a.jar", jar({"demo/O.class": make("demo/O"), "demo/O$V.class": make("demo/O$V", inner_of="demo/O"), "demo/O$Hidden.class": make("demo/O$Hidden", inner_of="demo/O"), "demo/Other.class": make("demo/Other")}))
    r = export.export_families(spark, [str(tmp_path / "a.jar")], str(tmp_path / "out"), engine.Engine(engine.summary, needs_siblings=True), deny="Hidden", project=str(tmp_path))
    assert (r.exported, r.filtered, r.failed_rows) == (1, 1, 2)
    assert "demo/O.java" not in files(tmp_path / "out") and "IncompleteFamily" in files(tmp_path / "out")["decompilation-failures.csv"].decode()


def test_cancelled_exports_start_nothing(spark, tmp_path):
    c = control.Cancellation(spark)
    with c.running():
        assert spark.range(5).count() == 5
    c.cancel()
    with pytest.raises(InterruptedError), c.running():
        spark.range(5).count()


def test_equal_outers_with_other_inners_are_two_families(spark, tmp_path):
    for n, body in (("a", b"11"), ("b", b"22"), ("copy", b"11")):
        put(tmp_path, f"{n}.jar", jar({"demo/O.class": make("demo/O"), "demo/O$I.class": make("demo/O$I", inner_of="demo/O", body=body)}))
    r = export.export_families(spark, [str(tmp_path / f"{n}.jar") for n in ("a", "b", "copy")], str(tmp_path / "out"), project=str(tmp_path))
    assert r.exported == 2


def test_partial_marks_only_in_comments():
    source = 'a = "// $FF: Couldn\'t be decompiled";\nb = """\n// $FF: Couldn\'t be decompiled\n""";\n/* // $FF: Couldn\'t be decompiled */\nc(); // $FF: Limits for x are exceeded.\r\n'
    assert [i[2].split(":")[0] for i in engine.partial_issues(source, "x")] == ["line 6"]


def test_folder_sink_refuses(tmp_path):
    root = str(tmp_path / "r")
    w = sinks.FolderWriter(root, False, False)
    w.write(iter([{"file_entry": "a/b", "content": b"1", "part": None, "path": None, "entry": None, "digest": None}]))
    with pytest.raises(sinks.ExportWriteError):
        sinks.put(root, "a/b", b"2")
    for bad in ("../x", "/x", "a\\b", ""):
        with pytest.raises(sinks.ExportWriteError):
            sinks.put(root, bad, b"")
    os.symlink(tmp_path, os.path.join(root, "link"))
    with pytest.raises(sinks.ExportWriteError):
        sinks.put(root, "link/x", b"")
    assert not [f for f in os.listdir(os.path.join(root, "a")) if f.endswith(".part")]
    assert sinks.next_free(str(tmp_path), "r") == str(tmp_path / "r-2")


def test_plans_carry_no_contents(spark, tmp_path, monkeypatch):
    """No exchange, window or cache holds a class's bytes: rows say where they are, and the writer reads them there."""
    put(tmp_path, "l/a.jar", jar({"demo/A.class": make("demo/A"), "in.jar": jar({"B.class": make("demo/B"), "C.class": make("demo/C")})}))
    put(tmp_path, "l/D.class", make("demo/D"))
    seen = {}
    real = sinks.export

    def spy(rows, *args, **kwargs):
        seen["rows"] = {r.file_entry: r for r in rows.filter("path is not null").collect()}
        seen["plan"] = rows._jdf.queryExecution().optimizedPlan().toString()
        return real(rows, *args, **kwargs)

    monkeypatch.setattr(sinks, "export", spy)
    before = set(os.listdir(shared(spark)))
    export.export_classes(spark, [str(tmp_path / "l")], str(tmp_path / "out"), project=str(tmp_path))
    assert set(seen["rows"]) == {f"demo/{x}.class" for x in "ABCD"} and all(r.content is None for r in seen["rows"].values())
    exchanges = [line for line in seen["plan"].splitlines() if "Repartition" in line or "Window" in line or "Aggregate" in line]
    assert exchanges and not [x for x in exchanges if "content" in x]
    assert files(tmp_path / "out")["demo/B.class"] == make("demo/B")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0 and set(os.listdir(shared(spark))) == before


def shared(spark):
    return spark.conf.get("spark.checkpoint.dir").removeprefix("file://")


def test_contents_are_those_that_were_scanned(tmp_path):
    data = make("demo/B")
    path = put(tmp_path, "a.jar", jar({"x/one.jar": jar({"two.jar": jar({"B.class": data, "C.class": b"c"}), "D.class": b"d"}), "E.class": b"e"}))
    with Contents() as c:
        assert [c.read(str(path), e) for e in ("x/one.jar!/two.jar!/B.class", "x/one.jar!/two.jar!/C.class", "x/one.jar!/D.class", "E.class")] == [data, b"c", b"d", b"e"]
        assert c.read(str(put(tmp_path, "F.class", b"f"))) == b"f"
        with pytest.raises(Changed):
            c.read(str(tmp_path / "F.class"), None, "0" * 64)


def test_archives_in_pieces_and_zip64(tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.Archive, "MANY", 2)  # more entries than a plain directory can count
    row = lambda name, content, part=None: {"file_entry": name, "content": content, "part": part, "path": None, "entry": None, "digest": None}
    w = sinks.ZipWriter(str(tmp_path / "a.zip"))
    put(tmp_path, "big", b"x" * 3_000_000)
    one = w.write(iter([row("r.txt", b"b\n", 2), row("a/ü", b"1"), row("z", b"")]))
    two = w.write(iter([row("r.txt", b"a\n", 1), row("r.txt", b"c\n", 3), {"file_entry": "copy", "content": None, "part": None, "path": str(tmp_path / "big"), "entry": None, "digest": None}]))
    w.commit([one, two, None])
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and z.namelist() == ["a/ü", "copy", "r.txt", "z"]
        assert [z.read(n) for n in z.namelist()] == [b"1", b"x" * 3_000_000, b"a\nb\nc\n", b""]
    assert os.listdir(tmp_path).count("a.zip") == 1 and not [f for f in os.listdir(tmp_path) if f.endswith(".parts")]


def test_an_incomplete_export_says_so(spark, tmp_path):
    put(tmp_path, "l/A.class", make("demo/A"))
    told = []
    c = control.Cancellation(spark)
    tell = lambda text: told.append(text) or (text == "write" and c.cancel())
    with pytest.raises(InterruptedError):
        export.export_classes(spark, [str(tmp_path / "l")], str(tmp_path / "out"), project=str(tmp_path), keep_completed=True, cancel=c, progress=tell)
    assert [t for t in told if ":" not in t] == ["scan", "plan", "write"]
    if (tmp_path / "out").exists():  # cancelled while it wrote, or right after
        assert "export-report.txt" in os.listdir(tmp_path / "out")
    with pytest.raises(RuntimeError), control.Flow(spark).running(str(tmp_path), True):
        raise RuntimeError("disk full")
    said = (tmp_path / "export-report.txt").read_text()
    assert said.startswith("status: incomplete") and "reason: RuntimeError: disk full" in said and "written_files:" in said


def interrupting(members):
    try:
        raise InterruptedError("stop")
    except InterruptedError as e:
        raise ValueError("wrapped") from e


def test_interruption_is_no_failure_of_an_item(spark, tmp_path):
    with pytest.raises(InterruptedError):
        engine.run_unit(engine.Engine(interrupting), [engine.Member("A", "o", "d", b"")])
    put(tmp_path, "l/A.class", make("demo/A"))
    with pytest.raises(Exception, match="InterruptedError"):
        export.export_families(spark, [str(tmp_path / "l")], str(tmp_path / "out"), engine.Engine(interrupting), project=str(tmp_path))
    assert not (tmp_path / "out").exists()


def test_failures_are_logged_up_to_a_limit(spark, caplog):
    rows = spark.createDataFrame([(f"o{i:02}", "why") for i in range(30)], "origin string, reason string")
    with caplog.at_level("WARNING", logger="quarry"):
        assert report.logged(rows) == 20 and len(caplog.records) == 20
    caplog.clear()
    with caplog.at_level("DEBUG", logger="quarry"):
        assert report.logged(rows) == 20 and [r.levelname for r in caplog.records] == ["WARNING"] * 20 + ["DEBUG"] * 10


def test_export_archive_denies_a_package_and_no_names(spark, tmp_path):
    """Digests that begin with de are part of the classes' names: only the package de is denied."""
    import duckdb

    from quarry import queries

    rows = [(i, f"text {n}", lang, "s") for i, (n, lang) in enumerate((n, lang) for n in (1, 203, 787) for lang in ("de", "en", "fr"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["export_archive"]).select("origin", "name", "digest").fetchall()
    got = queries.QUERIES["export_archive"](spark, str(tmp_path)).select("origin", "name", "digest").collect()
    assert len(want) == 6 and sorted(map(tuple, got)) == sorted(want)
