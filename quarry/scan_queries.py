"""Scans, transforms and exports of class files and archives that are made from the driver's tables, with DuckDB SQL that says what
must be found or written. They run the flows of quarry.plans as a user does.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import fixture
from quarry.functions import rules, text
from quarry.operators import collect, dedup, engine, family, report, resolve
from quarry.plans import export
from quarry.queries import R, U, items, query, table, turns
from quarry.session import materialise
from quarry.sources import artifacts

#: In SQL: the bytes of a class file as quarry.fixture makes them, from a name and a body.
CLASS = "(unhex('CAFEBABE0000003D000401') || unhex(printf('%04x', strlen({n}))) || encode({n}) || unhex('07000101') || unhex(printf('%04x', strlen({b}))) || encode({b}) || unhex('0021000200000000000000000000'))"
DIGEST = "sha256(coalesce(text, ''))"


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, name, content): a class for each document; equal texts of a language give equal classes."""
    d = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    name = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "DOC").otherwise("Doc"), F.left(digest, F.lit(2)))
    return d.select("doc_id", "lang", "source", name.alias("name"), fixture.class_file(name, digest).alias("content"))


C = f"""d AS (SELECT doc_id, lang, source, lang || '/' || (CASE WHEN doc_id % 5 = 0 THEN 'DOC' ELSE 'Doc' END) || left({DIGEST}, 2) AS name, {DIGEST} AS body FROM documents),
  c AS (SELECT *, sha256({CLASS.format(n='name', b='body')}) AS digest FROM d)"""


def source_jars(spark: SparkSession, sf_dir: str) -> str:
    """A folder with an archive for each source; entries do not say what their classes are called."""
    rows = classes(spark, sf_dir).select(F.concat(F.lit("lib/"), "source", F.lit(".jar")).alias("jar"), F.concat(F.col("doc_id").cast("string"), F.lit(".class")).alias("entry"), "content")
    return fixture.written(fixture.jars(rows), fixture.folder(spark))


J = C + """, u AS (SELECT doc_id, name, 'lib/' || source || '.jar!/' || doc_id || '.class' AS origin, 'lib/' || source || '.jar' AS grp, digest FROM c),
  v AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY name, digest ORDER BY origin) AS k FROM u) WHERE k = 1),
  p AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY lower(name)) > 1 THEN 'classes-conflicts/' || left(regexp_replace(grp, '[^\\p{L}\\p{N}._-]', '_', 'g'), 50) || '--' || left(digest, 16) || '/' ELSE '' END || name || '.class' AS file_entry FROM v)"""


@query(f"""WITH {C}, x AS (SELECT *, (['.hidden', 'build', 'node_modules', 'target/classes', 'src', '.git', 'all-in-one'])[doc_id % 7 + 1] || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.class' ELSE '.CLASS' END AS path FROM c)
SELECT path AS origin, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 <> 0 THEN name END AS name, CASE WHEN doc_id % 11 <> 0 THEN digest END AS digest FROM x WHERE doc_id % 7 < 5""")
def scan_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's loose classes: hidden and build folders are read, version control and earlier collections are not, extensions in any
    case; a broken class, and one whose name would lead out of the target, is a row with an error."""
    folders = F.array(*[F.lit(x) for x in (".hidden", "build", "node_modules", "target/classes", "src", ".git", "all-in-one")])
    c = classes(spark, sf_dir)
    path = F.concat(F.get(folders, (F.col("doc_id") % 7).cast("int")), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".class").otherwise(".CLASS"))
    bad = F.when(F.col("doc_id") % 22 == 0, fixture.class_file(F.lit("../Escape"), F.lit("x"))).when(F.col("doc_id") % 11 == 0, F.encode(F.lit("no class"), "UTF-8"))
    root = fixture.written(c.select(path.alias("file_entry"), F.coalesce(bad, "content").alias("content")), fixture.folder(spark))
    return artifacts.scan(spark, [root], mode="loose", project=root, content="false").select("origin", "status", "name", "digest")


@query(f"WITH {C}, x AS (SELECT *, 'all.jar!/lib/' || source || '.jar' AS grp FROM c), y AS (SELECT *, name LIKE 'fr/%' OR name LIKE 'es/%' AS denied FROM x) SELECT grp || '!/' || doc_id || '.class' AS origin, grp, 1 AS depth, CASE WHEN denied THEN 'filtered' ELSE 'ok' END AS status, name, CASE WHEN NOT denied THEN digest END AS digest FROM y")
def scan_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives within an archive, under deny rules, each origin once although its library is listed twice."""
    rows = classes(spark, sf_dir).select(F.concat(F.lit("lib/"), "source", F.lit(".jar")).alias("jar"), F.concat(F.col("doc_id").cast("string"), F.lit(".class")).alias("entry"), "content")
    root = fixture.written(fixture.jars(rows, "all.jar"), fixture.folder(spark))
    out = artifacts.scan(spark, [root, f"{root}/all.jar"], project=root, deny="fr, es.*", content="false")
    return out.select("origin", "grp", "depth", "status", "name", "digest")


@query(f"WITH {J} SELECT file_entry, digest FROM p")
def export_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of archives writes to a folder, read back."""
    root = source_jars(spark, sf_dir)
    target = f"{root}/out"
    export.export_classes(spark, [f"{root}/lib"], target, project=root)
    return artifacts.scan(spark, [target], project=target, content="false").select(F.col("origin").alias("file_entry"), "digest")


@query(f"WITH {J} SELECT 'out.jar!/' || file_entry AS origin, name, digest FROM p WHERE name NOT LIKE 'de/%'")
def export_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but for one package, to a ZIP archive, which is scanned again."""
    root = source_jars(spark, sf_dir)
    export.export_classes(spark, [f"{root}/lib"], f"{root}/out.jar", deny="de.*", project=root, format="zip")
    return artifacts.scan(spark, [f"{root}/out.jar"], project=root, content="false").select("origin", "name", "digest")


@query(f"WITH {J} SELECT file_entry || chr(9) || origin AS line FROM p UNION ALL SELECT 'file_entry' || chr(9) || 'source'")
def export_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = source_jars(spark, sf_dir)
    export.export_classes(spark, [f"{root}/lib"], f"{root}/out", project=root)
    return spark.read.text(f"file://{root}/out/{report.SOURCES}").select(F.col("value").alias("line"))


@query(f"WITH {J}, n AS (SELECT (SELECT count(*) FROM u) AS a, (SELECT count(*) FROM v) AS b) SELECT unnest(['status: complete', 'discovered: ' || a, 'filtered: 0', 'duplicates: ' || (a - b), 'exported: ' || b, 'complete_files: ' || b, 'partial_files: 0', 'failed_rows: 0', 'warnings: 1']) AS line FROM n UNION ALL SELECT 'external/' || ltrim('none/of/the/libraries', '/') || ': FileNotFoundError: no such library'")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report, with a warning for a library that is not there."""
    root = source_jars(spark, sf_dir)
    export.export_classes(spark, [f"{root}/lib", "/none/of/the/libraries"], f"{root}/out", project=root)
    return spark.read.text(f"file://{root}/out/{report.REPORT}").select(F.col("value").alias("line"))


def nested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_entry, content): conversations as folders of classes, each nested in the one of the turn before it, but every fourth."""
    t = turns(spark, sf_dir)
    return t.select(F.concat(F.lit("in/"), "origin", F.lit(".class")).alias("file_entry"), fixture.class_file(F.col("name"), F.concat("digest", "grp"), F.col("parent")).alias("content"))


@query(f"WITH {R}, f AS (SELECT conv_id, root, string_agg(lpad(turn::VARCHAR, 6, '0'), ',' ORDER BY turn <> root, turn) AS members FROM r WHERE conv_id IS NOT NULL GROUP BY ALL) SELECT conv_id, root, members FROM f WHERE root % 8 <> 4")
def family_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of nested classes, each given to an engine once as a whole; those that the engine fails on write no source."""
    root = fixture.written(nested_turns(spark, sf_dir), fixture.folder(spark))
    export.export_families(spark, [f"{root}/in"], f"{root}/out", engine.Engine(failing), project=root)
    src = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").option("pathGlobFilter", "*.java").text(f"file://{root}/out")
    cell = F.split(F.regexp_replace("value", "\n", ""), ";")
    return src.select(F.get(cell, F.lit(0)).cast("long").alias("conv_id"), F.split(F.get(cell, F.lit(1)), ",")[0].cast("long").alias("root"), F.get(cell, F.lit(1)).alias("members"))


def failing(members: list[engine.Member]) -> engine.Output:
    """conversation;names. Fails on roots 4, 12, 20, …, as an engine does on code that it cannot read."""
    if int(members[0].name) % 8 == 4:
        raise OSError('=cannot, "read"') from ValueError("inner")
    return engine.Output(f"{members[0].origin.split('/')[1]};{','.join(m.name for m in members)}\n")


@query(f"""WITH {R}, f AS (SELECT * FROM r WHERE conv_id IS NOT NULL AND root % 8 = 4) SELECT lpad(turn::VARCHAR, 6, '0') AS class_name, 'in/' || conv_id || '/' || lpad(turn::VARCHAR, 6, '0') || '.class' AS origin, 'OSError' AS error_type, 'OSError: =cannot, "read"' || chr(10) || 'caused by: ValueError: inner' AS reason FROM f""")
def family_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure report: a row for each member of a family that failed, with the chain of causes, cells quoted."""
    root = fixture.written(nested_turns(spark, sf_dir), fixture.folder(spark))
    export.export_families(spark, [f"{root}/in"], f"{root}/out", engine.Engine(failing), project=root)
    names = "class_name string, origin string, digest string, planned_path string, error_type string, reason string"
    rows = spark.read.schema(names).options(header="true", multiLine="true", quote='"', escape='"', lineSep="\r\n").csv(f"file://{root}/out/{report.FAILURES}")
    return rows.select("class_name", "origin", "error_type", "reason")


@query(f"WITH {U} SELECT doc_id, row_number() OVER (ORDER BY name, origin) - 1 AS position FROM u")
def unit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order of work, of rows that carry more than what orders them."""
    return dedup.positions(items(spark, sf_dir), ["name", "origin"]).select("doc_id", "position")


@query("SELECT doc_id, doc_id - doc_id % 500 AS root, (doc_id % 500)::BIGINT AS depth FROM documents WHERE doc_id IS NOT NULL")
def deep_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting far deeper than code has it: chains of 500."""
    at = lambda c: F.lpad(c.cast("string"), 12, "0")
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.lit("s").alias("scope"), at(F.col("doc_id")).alias("name"), F.when(F.col("doc_id") % 500 != 0, at(F.col("doc_id") - 1)).alias("parent"))
    return family.roots(d).select(F.col("name").cast("long").alias("doc_id"), F.col("root").cast("long").alias("root"), F.col("depth").cast("long").alias("depth"))


@query(r"""WITH u AS (SELECT source || '.jar!/' || lang || '/' || doc_id || '.class' AS src, lang || '/' || (CASE WHEN doc_id % 5 = 0 THEN 'DOC' ELSE 'Doc' END) || left(sha256(coalesce(text, '')), 2) || '.class' AS rel, source || '.jar' AS sroot, sha256(coalesce(text, '')) AS digest FROM documents),
d AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY rel, digest ORDER BY src) AS k FROM u) WHERE k = 1),
v AS (SELECT *, min(src) OVER (PARTITION BY rel) AS gkey, count(*) OVER (PARTITION BY rel) AS nv, row_number() OVER (PARTITION BY sroot, rel ORDER BY src) AS ord FROM d),
f AS (SELECT sroot, ord, arg_min(src, gkey || chr(0) || src) AS made, min(gkey || chr(0) || src) AS first FROM v WHERE nv > 1 GROUP BY ALL),
l AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(sroot, '/', '__') || CASE WHEN ord > 1 THEN '__from-' || regexp_extract(made, '[^/]*$') ELSE '' END, '[^\p{L}\p{N}._-]', '_', 'g'), '^[._]+', ''), '[._]+$', '') AS label FROM f),
n AS (SELECT sroot, ord, CASE WHEN row_number() OVER (PARTITION BY lower(label) ORDER BY first) > 1 THEN label || '--' || left(sha256(made), 12) ELSE label END AS name FROM l)
SELECT src, rel, CASE WHEN nv = 1 THEN 'classes' ELSE 'classes-conflicts/' || name END AS root, CASE WHEN nv = 1 THEN 0 ELSE v.ord END AS ordinal FROM v LEFT JOIN n ON v.sroot = n.sroot AND v.ord = n.ord""")
def conflict_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where versions of loose classes go; a sequential walk says the same in the tests."""
    u = items(spark, sf_dir)
    files = u.select(F.concat("origin", F.lit(".class")).alias("src"), F.concat("name", F.lit(".class")).alias("rel"), F.col("grp").alias("sroot"), "digest")
    return collect.planned(files).select("src", "rel", "root", "ordinal")


@query("SELECT doc_id, CASE WHEN d.doc_id % 3 = 0 THEN true ELSE false END AS reused, CASE WHEN doc_id % 3 = 1 THEN 'classes-conflicts/s' ELSE 'classes' END AS root FROM documents d WHERE doc_id IS NOT NULL")
def existing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection that is added to: equal files are reused, other ones kept beside the new version."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    rel = F.concat(F.col("doc_id").cast("string"), F.lit(".class"))
    there = d.filter("doc_id % 3 < 2").select(rel.alias("rel"), F.when(F.col("doc_id") % 3 == 0, F.col("digest")).otherwise("other").alias("digest"))
    plan = collect.planned(d.select(F.concat(F.lit("s/"), rel).alias("src"), rel.alias("rel"), F.lit("s").alias("sroot"), "digest"), "p", there)
    return plan.select(F.regexp_extract("rel", r"(\d+)", 1).cast("long").alias("doc_id"), "reused", "root")


@query("""WITH i AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN NULL ELSE role END AS named, role AS t, coalesce(text, '') AS reason FROM conversations WHERE conv_id IS NOT NULL), m AS (SELECT DISTINCT conv_id, role AS name FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT m.conv_id, m.name, i.turn, i.t, i.reason FROM i JOIN m ON i.conv_id = m.conv_id AND (i.named IS NULL OR i.named = m.name)),
f AS (SELECT conv_id, name, t, min(turn) AS k FROM a GROUP BY ALL), e AS (SELECT conv_id, name, string_agg(t, '; ' ORDER BY k) AS error_types FROM f GROUP BY ALL)
SELECT a.conv_id, a.name, any_value(error_types) AS error_types, sha256(string_agg(reason, chr(10) ORDER BY turn)) AS reason_sha256 FROM a JOIN e ON a.conv_id = e.conv_id AND a.name = e.name GROUP BY ALL""")
def issue_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of partial sources go to the member they name, those that name none to every member; reasons are joined in order."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    members = c.select("conv_id", "role").distinct().groupBy("conv_id").agg(F.collect_list(F.struct(F.col("role").alias("name"), F.lit("o").alias("origin"), F.lit("d").alias("digest"))).alias("members"))
    issue = F.struct(F.when(F.col("turn") % 3 != 0, F.col("role")).alias("internal_name"), F.col("role").alias("error_type"), F.coalesce("text", F.lit("")).alias("reason"))
    issues = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", issue.alias("i")))), lambda x: x["i"]).alias("issues"))
    got = resolve.joined_issues(resolve.attributed(members.join(issues, "conv_id").withColumnRenamed("conv_id", "unit")))
    return got.select(F.col("unit").alias("conv_id"), "name", F.col("error_type").alias("error_types"), F.sha2(F.col("reason").cast("binary"), 256).alias("reason_sha256"))


@query(f"""WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL) SELECT doc_id, 'line ' || (length(t) - length(replace(t, chr(10), '')) + 4) || ': // $FF: Couldn''t be decompiled' AS reason FROM x WHERE doc_id % 3 = 0""")
def partial_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of missing methods count in comments at the end of a line, not in strings, text blocks or block comments, which hold the document."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    inert = F.replace(F.replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\r", " "), F.lit("*/"), F.lit("* ")), F.lit("/*"), F.lit("/ "))
    source = F.concat(F.lit('String s = "// $FF: Couldn\'t be decompiled";\n/* // $FF: Couldn\'t be decompiled\n'), inert, F.lit("*/\n"), F.when(F.col("doc_id") % 3 == 0, "x(); // $FF: Couldn't be decompiled\n").otherwise("// $FF: fine\n"))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def issues(sources: pa.Array) -> pa.Array:
        return pa.array([[reason for _, _, reason in engine.partial_issues(s.as_py(), None)] for s in sources], pa.list_(pa.string()))

    return d.select("doc_id", F.explode(issues(source)).alias("reason"))


@query("SELECT doc_id, doc_id % 4 <> 3 AS found, CASE WHEN doc_id % 4 <> 3 THEN sha256(coalesce(text, '')) END AS digest FROM documents WHERE doc_id IS NOT NULL")
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of places, entries of archives and plain files alike; what is not there is said."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    place = (F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 2 == 0, F.lit("A.class")).alias("entry"))
    got = resolve.resolved(d.select("doc_id", *place), d.filter("doc_id % 4 <> 3").select(*place, F.coalesce("text", F.lit("")).cast("binary").alias("content")))
    return got.select("doc_id", "found", F.when(F.col("found"), F.sha2("content", 256)).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/p' WHEN doc_id % 3 = 1 THEN '/p/' || source ELSE '/p/' || source || '/x' END AS root, '/p/' || source || '!/' || doc_id AS origin, source || CASE WHEN doc_id % 2 = 0 THEN '__from-' || doc_id || '.class' ELSE '' END AS folder, lang || '.' || doc_id AS dotted, lang || '/' || doc_id || '.class' AS relative, (doc_id % 2 = 0)::BOOLEAN AS is_class FROM documents WHERE doc_id IS NOT NULL")
def source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths and names say: source roots, entry origins, folders for versions, dotted names, relative paths, extensions."""
    d = table(spark, sf_dir, "documents").filter("doc_id is not null")
    key, name = F.col("doc_id").cast("string"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"))
    relative = text.relative_path(name)
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/p/"), relative)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/p/"), "source", F.lit("/"), relative)).otherwise(F.concat(F.lit("/p/"), "source", F.lit("/x/"), key, F.lit(".class")))
    return d.select(
        "doc_id", text.source_root(path, relative, "/p").alias("root"), text.entry_origin(F.concat(F.lit("/p/"), "source"), key).alias("origin"),
        text.folder_name(F.col("source"), F.lit("project"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1), F.concat(key, F.lit(".class"))).alias("folder"),
        text.dotted(name).alias("dotted"), relative.alias("relative"), rules.has_extension(F.when(F.col("doc_id") % 2 == 0, F.lit("A.CLASS")).otherwise("A.java"), ".class").alias("is_class"),
    )


@query("SELECT page_id, len(list_filter(string_split(url, '/'), lambda s: s IN ('', '.', '..'))) > 0 OR regexp_matches(url, '[\\\\:;\\[]') AS bad, len(list_filter(string_split(regexp_extract(url, '^(.*)/[^/]*$', 1), '/'), lambda s: regexp_matches(s, '^h.*p.?:$'))) > 0 AS odd_glob FROM pages")
def unsafe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that must not become paths; and a rule with a ? among its letters, which reads segments as a whole."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", rules.unsafe_name(F.col("url")).alias("bad"), rules.accepts(F.col("url"), "h*p?:,h*p:").alias("odd_glob"))


@query("SELECT count(*) FILTER (doc_id % 3 <> 2) AS exported, count(*) FILTER (doc_id % 6 = 1) AS partial_files, count(*) FILTER (doc_id % 3 = 2) + count(*) FILTER (doc_id % 7 = 0) AS warnings, 2 * count(*) FILTER (doc_id % 3 = 2) AS failed_rows FROM documents")
def failure_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed unit is one warning and a row for each member; a partial source is exported, but not complete."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.when(F.col("doc_id") % 7 == 0, "error").otherwise("ok").alias("status"), F.lit("n").alias("name"), F.lit("d").alias("digest"))
    bad = F.col("doc_id") % 3 == 2
    results = d.select(F.when(bad, "broken").alias("error"), F.when(F.col("doc_id") % 6 == 1, F.array(F.lit("issue"))).otherwise(F.array().cast("array<string>")).alias("issues"))
    failed = d.filter(bad).select(F.explode(F.sequence(F.lit(1), F.lit(2))))
    return report.run_counts(rows, results, failed).select("exported", "partial_files", "warnings", "failed_rows")


@query(f"WITH {C}, x AS (SELECT DISTINCT 'p' || doc_id % 3 AS root, name, digest FROM c), n AS (SELECT name FROM x GROUP BY 1 HAVING count(DISTINCT digest) = 1) SELECT count(DISTINCT name) AS names, count(DISTINCT CASE WHEN name IN (SELECT name FROM n) THEN name END) AS in_main FROM x")
def collected_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's loose classes collected: one version goes to the main root, several to conflict roots, none is lost."""
    c = classes(spark, sf_dir)
    root = fixture.written(c.select(F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".class")).alias("file_entry"), "content"), fixture.folder(spark))
    none = spark.createDataFrame([], "library string, ordinal long, root string, kind string")
    export.collect_dependencies(spark, root, none, spark.createDataFrame([], "module string, library string"), spark.createDataFrame([("m",)], "module string"))
    out = f"{root}/{artifacts.COLLECTED}"
    got = materialise(artifacts.scan(spark, [out], project=out, content="false").select("name", F.startswith("origin", F.lit(collect.MAIN + "/")).alias("main")))
    return got.agg(F.count_distinct("name").alias("names"), F.count_distinct(F.when(F.col("main"), F.col("name"))).alias("in_main"))
