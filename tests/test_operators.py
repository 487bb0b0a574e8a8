import os
import random

import pytest
from classes import jar, make, put
from pyspark.sql import functions as F

from quarry.operators import catalog, collect, dedup, engine, family, resolve
from quarry.plans import export, resources
from quarry.streaming import incremental

MIB = 1 << 20


def test_cycles_and_twice_held_names_end_the_walk(spark):
    rows = [("s/1", "A", "B"), ("s/2", "B", "A"), ("s/3", "C", "C"), ("s/4", "D", "T"), ("s/5", "T", None), ("s/6", "T", None), ("s/7", "E", "gone"), *[(f"t/{i}", f"N{i}", f"N{i - 1}" if i else None) for i in range(20)]]
    df = spark.createDataFrame([(n, o, "g", f"d{o}", p) for o, n, p in rows], "name string, origin string, grp string, digest string, parent string")
    got = {(r.scope, r.name): r.root for r in family.assigned(df).collect()}
    assert got[("s", "A")] == "B" and got[("s", "B")] == "A" and got[("s", "C")] == "C" and got[("s", "D")] == "D" and got[("s", "E")] == "E"
    assert got[("t", "N19")] == "N0"
    both = {r.name: [m.name for m in r.members] for r in family.families(df).filter("scope = 's'").collect()}
    assert both["A"] == ["A", "B"] and both["B"] == ["B", "A"]


def sequential(files, project):
    """The allocation of conflict roots as a walk, for comparison."""
    import hashlib
    import re

    used, by_root, where, main = {"sources.tsv"}, {}, {}, []
    groups = {}
    for src, rel, sroot, digest in sorted(files):
        groups.setdefault(rel, []).append((src, rel, sroot, digest))
    held = set()
    for rel, entries in groups.items():
        versions = []
        for e in entries:
            if all(e[3] != v[3] for v in versions):
                versions.append(e)
        for src, _, sroot, _ in versions:
            if len(versions) == 1:
                main.append((src, "classes"))
                continue
            roots = by_root.setdefault(sroot, [])
            root = next((r for r in roots if (r, rel) not in held), None)
            if root is None:
                folder = sroot.replace("/", "__") or project
                label = re.sub(r"[^\w.-]", "_", folder + (f"__from-{src.rpartition('/')[2]}" if roots else "")).strip("._") or "project"
                short = label
                while len(short.encode()) > 120:
                    short = short[:-1]
                name = short
                if short != label or name.lower() in used:
                    name = f"{short}--{hashlib.sha256(src.encode()).hexdigest()[:12]}"
                used.add(name.lower())
                root = name
                roots.append(root)
            held.add((root, rel))
            where[src] = "classes-conflicts/" + root
    return dict(main) | where


@pytest.mark.parametrize("seed", range(3))
def test_conflict_roots_match_a_sequential_walk(spark, seed):
    rng = random.Random(seed)
    folders = ["a/b", "a__b", "A__B", "", "x" * 130, "ü" * 70, "..._", "p q", "sources.tsv"]
    files = {}
    for _ in range(60):
        s, r = rng.choice(folders), f"k/C{rng.randrange(6)}.class"
        src = (s + "/" if s else "") + f"{rng.randrange(40)}.class"
        files[src] = (src, r, s, str(rng.randrange(4)))
    df = spark.createDataFrame(list(files.values()), "src string, rel string, sroot string, digest string")
    assert {r.src: r.root for r in collect.planned(df, "proj").collect()} == sequential(files.values(), "proj")


def test_existing_targets_are_reused_or_kept(spark):
    df = spark.createDataFrame([("l/A.class", "A.class", "l", "1"), ("l/B.class", "B.class", "l", "2")], "src string, rel string, sroot string, digest string")
    there = spark.createDataFrame([("A.class", "1"), ("B.class", "other")], "rel string, digest string")
    got = {r.rel: (r.root, r.reused) for r in collect.planned(df, "p", there).collect()}
    assert got == {"A.class": ("classes", True), "B.class": ("classes-conflicts/l", False)}


def test_made_copy_names_do_not_overwrite(spark):
    df = spark.createDataFrame([("1", "x.jar"), ("2", "x.jar"), ("3", "x_2.jar")], "path string, file_name string")
    names = [r.copy_name for r in dedup.suffixed(df, "file_name", "path").collect()]
    assert len({n.lower() for n in names}) == 3 and {"x.jar", "x_2.jar"} <= set(names)


def test_issue_attribution(spark):
    m = [("A", "oa", "1"), ("B", "ob", "2")]
    df = spark.createDataFrame([("u", m, [("A", "T1", "r1"), (None, "T2", "r2"), ("Z", "T1", "r3")])], "unit string, members array<struct<name:string,origin:string,digest:string>>, issues array<struct<internal_name:string,error_type:string,reason:string>>")
    got = {r.name: (r.error_type, r.reason) for r in resolve.joined_issues(resolve.attributed(df)).collect()}
    assert got == {"A": ("T1; T2", "r1\nr2\nr3"), "B": ("T2; T1", "r2\nr3")}


def test_resolver_finds_entries_and_plain_files(spark):
    content = spark.createDataFrame([("a.jar", "X.class", bytearray(b"1")), ("B.class", None, bytearray(b"2"))], "path string, entry string, content binary")
    ask = spark.createDataFrame([("a.jar", "X.class"), ("B.class", None), ("a.jar", "Y.class")], "path string, entry string")
    assert sorted((r.path, r.entry or "", r.found) for r in resolve.resolved(ask, content).collect()) == [("B.class", "", True), ("a.jar", "X.class", True), ("a.jar", "Y.class", False)]


def test_resource_vectors():
    big = dict(cpus=16, total=32 << 30, free=24000 * MIB, heap_max=4096 * MIB, heap_used=1024 * MIB)
    assert [resources.limit(**big, hint=h) for h in (None, 32, 3, -1)] == [8, 15, 3, 8]
    assert resources.limit(**(big | {"cpus": 1}), hint=32) == resources.limit(**(big | {"free": 0}), hint=32) == resources.limit(**(big | {"heap_used": 3900 * MIB}), hint=32) == resources.limit(**(big | {"total": 0}), hint=32) == 1
    old = [(1024, 16, 0, 2), (2048, 16, 0, 6), (32768, 64, 0, 96), (4096, 1, 0, 2), (2048, 16, 512, 4), (2048, 16, 1800, 1), (256, 16, 0, 1)]
    assert [resources.historical_limit(h * MIB, c, u * MIB) for h, c, u, _ in old] == [n for *_, n in old]
    told, rendered = [], []
    p = resources.Progress(told.append, clock=lambda: 1.0)
    for i in range(10_000):
        p.update(lambda i=i: rendered.append(i) or str(i))
    assert len(told) == len(rendered) == 1


def test_resource_vectors_as_columns(spark):
    cases = [(16, 32 << 30, 24000 * MIB, 4096 * MIB, 1024 * MIB, h) for h in (None, 32, 3, -1)] + [(1, 32 << 30, 24000 * MIB, 4096 * MIB, 0, 32), (16, 0, 5, 4096 * MIB, 0, 32), (16, 32 << 30, -1, 4096 * MIB, 0, None), (4, 2 << 30, 1 << 30, 1 << 30, 3 << 30, None)]
    df = spark.createDataFrame(cases, "cpus long, total long, free long, heap_max long, heap_used long, hint long")
    got = df.select(resources.limit_column(*[F.col(c) for c in df.columns])).collect()
    assert [r[0] for r in got] == [resources.limit(*c) for c in cases]


def test_engine_contract():
    assert engine.describe(ValueError()).startswith("ValueError: ")
    a, b = ValueError("a"), ValueError("b")
    a.__cause__, b.__cause__ = b, a
    assert engine.describe(a).count("ValueError") == 2
    one = engine.Engine(lambda m: engine.Output("x"), merges=False)
    m = engine.Member("A", "o", "d", b"")
    assert engine.run_unit(one, [m])[0] == "x" and engine.run_unit(one, [m, m])[4]
    assert engine.run_unit(engine.Engine(lambda m: engine.Output("  \n")), [m])[3] == "ValueError"
    assert engine.Engine(engine.summary, parallelism_hint=0).hint is None


def test_collecting_dependencies(spark, tmp_path):
    p = tmp_path / "proj"
    put(p, "libs/x.jar", jar({"A.class": make("A")}))
    put(p, "more/x.jar", jar({"B.class": make("B")}))
    put(p, "node_modules/y.jar", b"")
    put(p, "a/target/classes/demo/C.class", make("demo/C", body=b"1"))
    put(p, "b/classes/demo/C.class", make("demo/C", body=b"2"))
    put(p, "b/classes/demo/D.class", make("demo/D"))
    put(p, "bad.class", b"zz")
    roots = spark.createDataFrame([("old", 0, "file:///x", "CLASSES")], "library string, ordinal long, root string, kind string")
    mods = spark.createDataFrame([("m1",), ("m2",)], "module string")
    library, attached = export.collect_dependencies(spark, str(p), roots, spark.createDataFrame([("m1", "old")], "module string, library string"), mods)
    out = p / "all-in-one"
    got = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs)
    assert got == ["classes-conflicts/a__target__classes/demo/C.class", "classes-conflicts/b__classes/demo/C.class", "classes-conflicts/sources.tsv", "classes/demo/D.class", "x.jar", "x_2.jar"]
    assert attached.count() == 3 and library.filter("library = 'all-in-one'").count() == 5
    with pytest.raises(FileExistsError):
        export.collect_dependencies(spark, str(p), roots, attached, mods)
    assert "/x" in {r.path for r in catalog.registered(library, attached).collect()}


def test_incremental_catalogue_keeps_first_arrivals(spark, tmp_path):
    rows = [("A", "o1", "g", "1"), ("A", "o2", "g", "1"), ("A", "o3", "g", "2")]
    df = spark.createDataFrame(rows, "name string, origin string, grp string, digest string").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = incremental.catalogue(incremental.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_positions_of_wide_rows(spark):
    """Partitions are coalesced by their sizes at run time, which differ between a narrow and a wide evaluation; no row may be lost."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.repeat(F.lit("wide "), 40).alias("w"))
        got = dedup.positions(df, ["k"])
        assert got.columns == ["k", "w", "position"]
        assert got.agg(F.count("w"), F.min("position"), F.max("position"), F.count_distinct("position")).first() == (100_000, 0, 99_999, 100_000)
        assert [r.k for r in got.orderBy("position").limit(50).collect()] == sorted(i * 7919 % 100_003 for i in range(100_000))[:50]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_roots_at_any_depth(spark):
    chain = [("a", f"N{i:04}", f"N{i - 1:04}" if i else None) for i in range(1000)]
    ring = [("r", f"R{i:03}", f"R{(i + 1) % 100:03}") for i in range(100)] + [("r", "tail", "R000"), ("r", "tail2", "tail")]
    got = {(r.scope, r.name): (r.root, r.depth) for r in family.roots(spark.createDataFrame([*chain, *ring, ("z", "self", "self"), ("z", "lost", "gone")], "scope string, name string, parent string")).collect()}
    want = {("a", f"N{i:04}"): ("N0000", i) for i in range(1000)} | {("r", f"R{i:03}"): (f"R{(i - 1) % 100:03}", 99) for i in range(100)}
    assert got == want | {("r", "tail"): ("R099", 100), ("r", "tail2"): ("R099", 101), ("z", "self"): ("self", 0), ("z", "lost"): ("lost", 0)}
    assert family.roots(spark.createDataFrame([], "scope string, name string, parent string")).count() == 0


def test_collisions_of_a_common_name(spark):
    df = spark.createDataFrame([(n,) for n in ("a/X", "A/x", "b/Y", "module-info", "module-info", "module-info")], "name string")
    assert sorted((r.name, r.n_same) for r in dedup.collisions(df).collect()) == sorted([("a/X", 2), ("A/x", 2), ("b/Y", 1), *[("module-info", 3)] * 3])


def test_admission_follows_the_machine():
    import threading

    cpus, order = [2], []
    now = lambda: {"cpus": cpus[0], "total": 32 << 30, "free": 24000 * MIB, "heap_max": 4096 * MIB, "heap_used": 0}
    permit = lambda: resources.Admission(None, now, f"test-{os.getpid()}")

    def second():
        with permit():
            order.append("second")

    with permit():  # one runs at a time
        t = threading.Thread(target=second)
        t.start()
        t.join(0.3)
        assert order == [] and t.is_alive()
        cpus[0] = 3  # the limit is sampled anew: there is room for another
        t.join(5)
        assert order == ["second"]
    assert set(resources.sample()) == {"cpus", "total", "free", "heap_max", "heap_used"} and resources.limit(**resources.sample()) >= 1


def test_a_catalog_is_replaced_as_a_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert catalog.committed(spark.range(3), path).count() == 3
    old = spark.read.parquet(path)
    assert catalog.committed(old.filter("id > 0"), path).count() == 2 and spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="boom"):
        catalog.committed(spark.range(1).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path)
    assert spark.read.parquet(path).count() == 2


def test_adding_to_a_collection(spark, tmp_path):
    p = tmp_path / "proj"
    put(p, "m/A.class", make("A"))
    put(p, "m/B.class", make("B"))
    roots, mods = spark.createDataFrame([], "library string, ordinal long, root string, kind string"), spark.createDataFrame([("m",)], "module string")
    has, done = spark.createDataFrame([], "module string, library string"), []
    collected = lambda **more: export.collect_dependencies(spark, str(p), roots, has, mods, tables=f"file://{tmp_path}/catalog", succeeded=lambda: done.append(1), **more)
    collected()
    put(p, "m/B.class", make("B", body=b"new"))
    put(p, "x.jar", jar({"A.class": make("A")}))
    library, attached = collected(merge=True)
    out = p / "all-in-one"
    got = {os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs}
    assert got == {"classes/A.class", "classes/B.class", "classes-conflicts/m/B.class", "classes-conflicts/sources.tsv", "x.jar"}
    assert (out / "classes/B.class").read_bytes() == make("B") and len(done) == 2 and attached.count() == 1
    assert spark.read.parquet(f"file://{tmp_path}/catalog/library_root").count() == library.count() == 3
    (out / "classes/A.class").unlink()
    os.symlink(p / "m/A.class", out / "classes/A.class")
    with pytest.raises(FileExistsError):
        collected(merge=True)
    assert len(done) == 2
