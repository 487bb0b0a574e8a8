"""The artifact operators applied to the driver's tables, with DuckDB SQL that says what they must return.

The tables hold no class files, so columns stand in for them: a document is a class item (its text the content), a conversation's
turns are a family, a page's URL a dotted package or a path. The operators are the ones that real scans use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import rules, text
from quarry.operators import catalog, dedup, family, report, resolve
from quarry.plans import resources
from quarry.session import ready

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as class items. The text itself is read for its digest only."""
    d = table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    name = F.concat("lang", F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "DOC").otherwise("Doc"), F.left(digest, F.lit(2)))
    return d.select("doc_id", name.alias("name"), F.concat("source", F.lit(".jar!/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("origin"), F.concat("source", F.lit(".jar")).alias("grp"), digest.alias("digest"), F.lit("ok").alias("status"))


U = """u AS (SELECT doc_id, lang || '/' || (CASE WHEN doc_id % 5 = 0 THEN 'DOC' ELSE 'Doc' END) || left(sha256(coalesce(text, '')), 2) AS name,
  source || '.jar!/' || lang || '/' || doc_id AS origin, source || '.jar' AS grp, sha256(coalesce(text, '')) AS digest FROM documents)"""
V = U + """, v AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY name, digest ORDER BY origin) n FROM u) WHERE n = 1)"""
T = """t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS digest, CASE WHEN turn % 4 = 0 THEN NULL ELSE turn - 1 END AS parent FROM conversations)"""
R = T + """, r AS (SELECT a.*, (SELECT max(b.turn) FROM t b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND (b.parent IS NULL OR b.parent NOT IN (SELECT turn FROM t c WHERE c.conv_id = a.conv_id))) AS root FROM t a)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as nested classes: each is nested in the turn before it, but every fourth."""
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null")
    at = lambda n: F.lpad(n.cast("string"), 6, "0")
    parent = F.when(F.col("turn") % 4 != 0, at(F.col("turn") - 1))
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), at(F.col("turn"))).alias("origin"), at(F.col("turn")).alias("name"), F.col("conv_id").cast("string").alias("grp"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), parent.alias("parent"))


@query(f"WITH {V}, p AS (SELECT *, count(*) OVER (PARTITION BY lower(name)) AS n_same FROM v) SELECT doc_id, name, origin, digest, n_same, CASE WHEN n_same > 1 THEN 'classes-conflicts/' || coalesce(nullif(left(regexp_replace(grp, '[^\\p{{L}}\\p{{N}}._-]', '_', 'g'), 50), ''), 'project') || '--' || left(digest, 16) || '/' ELSE '' END || name || '.class' AS file_entry FROM p")
def conflict_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.planned_paths(dedup.distinct_versions(items(spark, sf_dir))).select("doc_id", "name", "origin", "digest", "n_same", "file_entry")


@query(f"WITH {V} SELECT doc_id, name, origin, digest FROM v")
def dedup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.distinct_versions(items(spark, sf_dir)).select("doc_id", "name", "origin", "digest")


@query(f"WITH {U} SELECT doc_id, row_number() OVER (PARTITION BY name, digest ORDER BY origin) > 1 AS duplicate FROM u")
def flag_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.rank_versions(items(spark, sf_dir)).select("doc_id", (~F.col("is_first")).alias("duplicate"))


@query(f"WITH {V}, c AS (SELECT count(*) n, count(DISTINCT digest) d FROM v GROUP BY lower(name)) SELECT (SELECT count(*) FROM u) AS discovered, (SELECT count(*) FROM u) - (SELECT count(*) FROM v) AS duplicates, (SELECT count(*) FROM v) AS exported, (SELECT coalesce(sum(n), 0)::BIGINT FROM c WHERE n > 1) AS in_conflict, (SELECT count(*) FROM c WHERE n > 1) AS conflict_groups")
def export_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = items(spark, sf_dir)
    seen = report.run_counts(u, None, None).select("discovered", "duplicates", (F.col("discovered") - F.col("duplicates")).alias("exported"))
    return report.one_row(seen, dedup.conflicts(dedup.distinct_versions(u)))


@query(f"WITH {U} SELECT count(*) AS discovered, count(*) FILTER (doc_id % 7 = 0) AS filtered, count(*) FILTER (doc_id % 7 <> 0) - count(DISTINCT CASE WHEN doc_id % 7 <> 0 THEN name || digest END) AS duplicates FROM u")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("status", F.when(F.col("doc_id") % 7 == 0, "filtered").otherwise("ok"))
    return report.run_counts(rows, None, None).select("discovered", "filtered", "duplicates")


@query(f"WITH {U}, x AS (SELECT doc_id, left(digest, 2) || '.jar' AS file_name FROM u), y AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY doc_id) n FROM x) SELECT doc_id, file_name, CASE WHEN n = 1 THEN file_name ELSE left(file_name, length(file_name) - 4) || '_' || n || '.jar' END AS copy_name FROM y")
def suffix_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("doc_id", F.concat(F.left("digest", F.lit(2)), F.lit(".jar")).alias("file_name"))
    return dedup.suffixed(rows, "file_name", "doc_id").select("doc_id", "file_name", "copy_name")


@query(f"WITH {U}, x AS (SELECT (row_number() OVER (ORDER BY name, origin) - 1) // 40 AS batch FROM u) SELECT batch, count(*) AS n FROM x GROUP BY 1")
def batch_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.batches(items(spark, sf_dir).select("name", "origin"), ["name", "origin"])


@query(f"WITH {R} SELECT conv_id, turn, root FROM r WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
def family_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family.assigned(turns(spark, sf_dir)).select(F.col("grp").cast("long").alias("conv_id"), F.col("name").cast("long").alias("turn"), F.col("root").cast("long").alias("root"))


@query(f"WITH {R} SELECT conv_id, root, count(*) AS n_members, CASE WHEN count(*) = 1 THEN min(digest) ELSE sha256(string_agg(lpad(turn::VARCHAR, 6, '0') || ':' || digest || chr(10), '' ORDER BY turn <> root, turn)) END AS digest FROM r GROUP BY ALL")
def family_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = family.families(turns(spark, sf_dir))
    return f.select(F.col("grp").cast("long").alias("conv_id"), F.col("name").cast("long").alias("root"), F.size("members").cast("long").alias("n_members"), "digest")


@query(f"WITH {R}, f AS (SELECT conv_id, root, count(*) n, string_agg(digest, ',' ORDER BY turn <> root, turn) d FROM r GROUP BY ALL) SELECT root, n AS n_members, count(DISTINCT d) AS n_families FROM f GROUP BY ALL")
def family_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = family.distinct_families(family.families(turns(spark, sf_dir)))
    return f.groupBy(F.col("name").cast("long").alias("root"), F.size("members").cast("long").alias("n_members")).agg(F.count(F.lit(1)).alias("n_families"))


HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"


@query(f"WITH h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT page_id, host FROM h WHERE len(list_filter(string_split(host, '.'), lambda s: starts_with(s, 'th'))) > 0 AND len(list_filter(string_split(host, '.'), lambda s: contains(s, 'blog'))) = 0")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1).alias("host"))
    return h.filter(rules.accepts(F.concat(F.replace("host", F.lit("."), F.lit("/")), F.lit("/-")), "*th", "*blog*"))


@query(f"WITH h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT page_id, host FROM h WHERE (regexp_matches(host, '^.*\\.example\\.com$') OR ends_with(host, 'net') OR contains(host, 'org')) AND NOT regexp_matches(host, '^m\\..*')")
def rule_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1).alias("host"))
    return h.filter(rules.accepts(F.concat(F.replace("host", F.lit("."), F.lit("/")), F.lit("/-")), "*.example.com, *.???net，*.net\norg", "m.*"))


@query("SELECT page_id, 'external/' || list_aggregate((list_filter(string_split(regexp_replace(url, '^[a-z]+:', ''), '/'), lambda x: x <> ''))[-4:], 'string_agg', '/') AS label FROM pages")
def source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.source_label(F.regexp_replace("url", "^[a-z]+:", ""), "/project").alias("label"))


@query("""SELECT conv_id, turn, '"' || CASE WHEN regexp_matches(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '^[=+@-]') OR regexp_matches(text, '^[' || chr(9) || chr(13) || ']') THEN chr(39) ELSE '' END || replace(text, '"', '""') || '"' AS cell FROM conversations""")
def csv_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.csv_cell(F.col("text")).alias("cell"))


@query("SELECT doc_id, sha256(replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')) AS cell_sha256 FROM documents")
def tsv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.tsv_cell(F.col("text")).cast("binary"), 256).alias("cell_sha256"))


@query("WITH s AS (SELECT conv_id, turn, length(text) > 1500 AS missing FROM conversations) SELECT conv_id FROM s GROUP BY 1 HAVING NOT coalesce(bool_or(missing), false) AND conv_id IS NOT NULL")
def sibling_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter("conv_id is not null")
    place = F.concat(F.lit("c/Turn$"), F.col("turn").cast("string"), F.lit(".class"))
    entries = c.select(F.col("conv_id").alias("container"), place.alias("place"), F.coalesce(F.length("text") > 1500, F.lit(False)).alias("missing"))
    units = entries.select(F.col("container").alias("unit"), "container", F.lit("c/Turn.class").alias("place")).distinct()
    chosen = entries.filter(~F.col("missing")).select(F.col("container").alias("unit"), "container", "place")
    bad = resolve.incomplete(resolve.siblings(units, entries), chosen)
    return units.join(bad, "unit", "left_anti").select(F.col("unit").alias("conv_id"))


@query("SELECT d.doc_id FROM documents d JOIN benchmark b ON d.doc_id = b.item_id WHERE sha256(coalesce(d.text, '')) <> sha256(coalesce(b.text, ''))")
def stale_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")
    snap = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("unit"), F.col("item_id").cast("string").alias("path"), F.lit(None).cast("string").alias("entry"), digest)
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("entry"), digest)
    known = snap.join(now.select("path"), "path", "left_semi")
    return resolve.stale(known, now).select(F.col("unit").alias("doc_id"))


@query("SELECT doc_id, (o - 1)::BIGINT AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS o FROM documents) WHERE starts_with(l, 'The')")
def marker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return lines.filter(F.startswith("text", F.lit("The"))).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query("SELECT source AS path FROM documents UNION SELECT lang FROM documents")
def root_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    one = lambda c, lib: d.select(F.lit(lib).alias("library"), F.lit(0).cast("long").alias("ordinal"), F.col(c).alias("root"), F.lit("CLASSES").alias("kind"))
    used = spark.createDataFrame([("m", "a")], "module string, library string")
    return catalog.registered(one("source", "a").unionByName(one("lang", "b")).distinct(), used, spark.createDataFrame([("b",)], "library string"))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 20")
def preview20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.preview(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


@query("WITH f AS (SELECT conv_id, role, min(turn) t FROM conversations GROUP BY ALL), g AS (SELECT conv_id, string_agg(role, '; ' ORDER BY t) AS error_types FROM f GROUP BY 1) SELECT g.conv_id, error_types, sha256((SELECT string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FROM conversations c WHERE c.conv_id = g.conv_id)) AS reason_sha256 FROM g")
def join_error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    issue = F.struct(F.lit(None).cast("string").alias("internal_name"), F.col("role").alias("error_type"), F.coalesce("text", F.lit("")).alias("reason"))
    rows = c.select(F.col("conv_id").alias("unit"), F.lit("m").alias("name"), F.lit("o").alias("origin"), F.lit("d").alias("digest"), F.col("turn").alias("nth"), issue.alias("issue"))
    return resolve.joined_issues(rows).select(F.col("unit").alias("conv_id"), F.col("error_type").alias("error_types"), F.sha2(F.col("reason").cast("binary"), 256).alias("reason_sha256"))


@query("SELECT doc_id, strlen(text)::BIGINT AS n_bytes FROM documents")
def byte_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"WITH {U}, m AS (SELECT grp, digest, min(doc_id) AS first_doc FROM u GROUP BY ALL) SELECT grp, count(*) AS n_versions, sum(first_doc)::BIGINT AS first_sum FROM m GROUP BY 1")
def content_versions_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    reps = dedup.representatives(items(spark, sf_dir).select("doc_id", "grp", "digest"), "doc_id", "grp", "digest")
    return reps.groupBy("grp").agg(F.count(F.lit(1)).alias("n_versions"), F.sum("doc_id").alias("first_sum"))


@query("SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}._-]', '_', 'g'), '^[._]+', ''), '[._]+$', ''), ''), 'project') AS safe FROM documents")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_name(F.col("text")).alias("safe"))


@query("SELECT doc_id, list_max(list_filter(range(0, 121), lambda n: strlen(left(text, n)) <= 120 AND n <= length(text)))::BIGINT AS kept FROM documents")
def byte_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text.byte_bounded(F.col("text"))).cast("long").alias("kept"))


@query("SELECT p.module, p.library FROM (SELECT DISTINCT lang AS module, 'all-in-one' AS library FROM documents) p UNION SELECT DISTINCT lang, source FROM documents WHERE lang <> 'en'")
def attach_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    has = d.filter("lang <> 'en'").select(F.col("lang").alias("module"), F.col("source").alias("library")).distinct()
    return catalog.attached(has, d.select(F.col("lang").alias("module")))


@query("SELECT o_orderkey, greatest(least(7, (4294967296 - o_orderkey * 1048576 % 4294967296 - 1073741824) // 268435456, 8), 1)::BIGINT AS jobs FROM orders")
def resource_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admission formula over a table of machines: all alike but for the heap in use."""
    used = (F.col("o_orderkey") * 1048576 % 4294967296).cast("long")
    big = lambda n: F.lit(n << 30).cast("long")
    jobs = resources.limit_column(F.lit(8), big(32), big(24), big(4), used)
    return table(spark, sf_dir, "orders").select("o_orderkey", jobs.alias("jobs"))


@query("SELECT url, page_id, row_number() OVER (PARTITION BY lower(url) ORDER BY page_id) AS nth FROM pages")
def path_seen_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.nth_seen(table(spark, sf_dir, "pages").select("url", "page_id"), F.lower("url"), "page_id")


@query("SELECT page_id, NOT (url = '' OR regexp_matches(url, '[\\\\:]') OR len(list_filter(string_split(url, '/'), lambda s: s IN ('', '.', '..'))) > 0) AS safe FROM pages")
def entry_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_entry(F.col("url")).alias("safe"))


FLAGSHIP = "conflict_paths"

from quarry import scan_queries  # noqa: E402, F401  it adds its queries to the tables above
