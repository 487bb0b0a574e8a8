"""Every registered query as the driver calls it: on real tables against SQL or brute force, on awkward tables, on empty ones."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_llm import check_pieces, measures, prose, reference_ids, slow_components, slow_fingerprint, slow_repeats, words

import corpus_pipeline
from quarry.llm import decontaminate, html, oracles, queries

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(map(tuple, df.select(*cols).collect()))


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols, got = rows_of(queries.QUERIES[name](spark, sf))
    want = con.sql(oracles.SQL[name])
    assert cols == sorted(want.columns) and got == Counter(want.select(*[f'"{c}"' for c in cols]).fetchall())


#: Names that operators use for columns of their own.
CLASHING = "shard slot grown_shard size law key k a b n first node root archive offset length path fp page line bucket _h_text _q_n_words _q_all _t_score _x_chunk _x_kept _d_key _d_fp _s_piece _j_key _b_key".split()


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    """A folder of tables with nulls everywhere, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    folder = f"file://{tmp_path_factory.mktemp('awkward')}"
    extra = ", ".join(f"{c} string" for c in CLASHING)
    long, near, passage = prose(25_000, 1), prose(300, 2), prose(60, 3)
    texts = [None, "", " \n\t", "one", long, long, near, near + " tail", near.upper(), passage, prose(80, 4) + "\n" + passage, "a " * 300, "# $ % " * 60, prose(90, 6), near, prose(70, 8) + " you idiot! " + prose(20, 9)]
    docs = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)] + [(None, near, None, None, None), (None, None, None, None, None), (6, near, "en", "s0", 0), (7, prose(120, 10), "en", "s1", 0), (13, prose(90, 6), "en", "s1", 0)]
    pages = [(1, "u", "<article><p>" + "x y " * 9000 + "</p></article>"), (2, None, None), (None, "u", "<p>" + "z" * 200), (3, "u", ""), (4, "v", "<p>" + "z" * 200), (5, "v", "<p>" + "z" * 200), (5, "v", "<p>" + "z" * 200)]
    talks = [(1, 0, "user", None), (1, 1, "assistant", "x" * 100_000), (None, 0, None, "n"), (2, None, "assistant", ""), (2, 0, "user", "t"), (2, 0, "user", "t")]
    for name, schema, rows in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long", docs),
        ("pages", "page_id long, url string, html string", pages),
        ("benchmark", "item_id long, text string", [(1, passage), (2, None), (3, ""), (4, "one two three"), (None, prose(40, 77)), (1, passage)]),
        ("labels", "doc_id long, quality int, toxic int", [(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (5, 1, 0)]),
        ("conversations", "conv_id long, turn long, role string, text string", talks),
    ):
        spark.createDataFrame([(*r, *["old"] * len(CLASHING)) for r in rows], f"{schema}, {extra}").repartition(2).write.parquet(f"{folder}/{name}.parquet")
        spark.createDataFrame([], f"{schema}, {extra}").write.parquet(f"{folder}/none/{name}.parquet")
    return folder, docs, pages


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_awkward_and_empty_tables(spark, awkward, name):
    folder, docs, pages = awkward
    n = queries.QUERIES[name](spark, folder).count()
    want = {"op1_max_subsequence": len(pages), "op7_zip_warc": len(pages), "op10_chat_format": 4}
    assert n == want.get(name, n if name in ("pipeline", "op4_cgk_decontamination", "op8_sum_of_squares") else len(docs))
    assert queries.QUERIES[name](spark, f"{folder}/none").count() == (1 if name == "op10_chat_format" else 0)


def test_awkward_results(spark, awkward):
    folder, docs, pages = awkward
    out = queries.QUERIES["op1_max_subsequence"](spark, folder).collect()
    assert Counter((r.page_id, r.n_chars) for r in out) == Counter([(1, 35_999), (2, 0), (None, 200), (3, 0), (4, 200), (5, 200), (5, 200)])
    out = queries.QUERIES["op7_zip_warc"](spark, folder).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out if r.payload_bytes == 203) == Counter([(4, "response", None), (None, "revisit", 4), (5, "revisit", 4), (5, "revisit", 4)])
    out = queries.QUERIES["op2_ring_sharding"](spark, folder).collect()
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(8)) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(k)) for s, k in sizes.items())
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d[0], len((d[1] or "").encode()) + 1, crc(d[1])) for d in docs)
    out = queries.QUERIES["op9_block_anchors"](spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in out) == Counter((d[0], *x[:2]) for d, x in zip(docs, slow_repeats([d[1] for d in docs]), strict=True))
    out = queries.QUERIES["op4_cgk_decontamination"](spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(9, 1), (10, 1)}


def real(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_sharding_query(spark, sf):
    docs, out = real(spark, sf), queries.QUERIES["op2_ring_sharding"](spark, sf).collect()
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in docs}
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1


def test_toxicity_query(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    out = queries.QUERIES["op3_pattern_grammar"](spark, sf).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [(toxic[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in toxic]
    hits = Counter(held)
    assert hits[1, 1] >= 4 * (hits[0, 1] + 1) and hits[1, 1] >= 0.5 * (hits[1, 1] + hits[1, 0])  # some labels are noise


def leaks_of(docs, items):
    """By the exact distance of every item to every text."""
    out = set()
    for i, t in docs:
        text = decontaminate.plain(t)
        for k, p in items:
            if p and text and (decontaminate.edit_match(p, text)[0] <= decontaminate.limit_of(len(p)) if len(p) >= decontaminate.SHORT else f" {p} " in f" {text} "):
                out.add((i, k))
    return out


def test_decontamination_query(spark, sf):
    items = [(r.item_id, decontaminate.plain(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in real(spark, sf) if len(t or "") < 8000]
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_cgk_decontamination"](spark, sf).collect() if r.doc_id in dict(docs)}
    assert got == leaks_of(docs, items)


def test_simhash_query(spark, sf):
    fp = {i: slow_fingerprint(t) for i, t in real(spark, sf)}
    want = slow_components(fp)
    out = queries.QUERIES["op6_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in out} == {(i, f"{fp[i]:016x}", want[i]) for i in fp}


def test_packing_query(spark, sf):
    docs = real(spark, sf)
    ids = dict(zip([i for i, _ in docs], reference_ids([t for _, t in docs]), strict=True))
    out = queries.QUERIES["op8_sum_of_squares"](spark, sf)
    per_doc, per_seq = check_pieces(out.collect(), ids)
    assert set(per_doc) == set(ids) and len(per_seq) <= sum(map(len, ids.values())) // 2048 + out.rdd.getNumPartitions() + 1


# ---- the pipeline by brute force ----------------------------------------------------------------------------------


def slow_quality(rows):
    """(id, text, host) that pass: measures, a beta prior by moments over hosts, posterior log odds."""
    of = {i: (*measures(t), len([x for x in (t or "").split("\n") if words(x)])) for i, t, _ in rows}
    base = lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0]
    symbols, dups = (lambda m: 100 * m[2] > 10 * m[0]), (lambda m: 100 * m[3] > 30 * m[5])
    hosts = defaultdict(list)
    for i, _, h in rows:
        hosts[h].append(base(of[i]) or symbols(of[i]) or dups(of[i]))
    n, f = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    m, k = f / n, len(hosts)
    n2, f2 = sum(len(x) ** 2 for x in hosts.values()), sum(sum(x) ** 2 / len(x) for x in hosts.values())
    between = (f2 - m * m * n - (k - 1) * m * (1 - m)) / (n - n2 / n) if n * n > n2 else 0
    weight = min(1000.0, max(2.0, m * (1 - m) / between - 1)) if between > 0 else 1000.0
    out = []
    for i, t, h in rows:
        r = min(max((sum(hosts[h]) + m * weight) / (len(hosts[h]) + weight), 1e-6), 1 - 1e-6)
        odds = math.log(r / (1 - r)) + (4.0 if symbols(of[i]) else -1.0) + (0.5 if dups(of[i]) else -0.1)
        if not base(of[i]) and odds <= 0:
            out.append((i, t, h))
    return out


def slow_near(rows):
    kept = slow_components({i: slow_fingerprint(t) for i, t, _ in rows})
    rows = [r for r in rows if kept[r[0]] == r[0]]
    sets = {}
    for i, t, _ in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def test_pipeline_equals_a_brute_force_one(spark, tmp_path):
    r = random.Random(41)
    items = [(i, prose(r.randrange(20, 50), 100 + i)) for i in range(5)]
    shared, rows = prose(60, 900), []
    for i in range(70):
        own = prose(r.randrange(60, 200), 1000 + i)
        kind = i % 10
        if kind == 1:
            own = own + " " + shared
        elif kind == 2:
            own = own + "\n" + items[i // 10 % 5][1].capitalize()
        elif kind == 3:
            own = prose(20, i)
        elif kind == 4:
            own = "# $ " * 40 + own
        elif kind == 5 and rows:
            own = r.choice(rows)[1]
        elif kind == 6 and rows:
            w = r.choice(rows)[1].split()
            w[len(w) // 2] = "changed"
            own = " ".join(w)
        rows.append((i, own, f"h{i % 4}"))
    spark.createDataFrame([(i, t, "en", h, len(t), "x") for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long, _q_n_words string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = slow_near(slow_quality(rows))
    cleaned = [(i, x[2] if x[1] else t, h) for (i, t, h), x in zip(want, slow_repeats([t for _, t, _ in want]), strict=True)]
    leaky = leaks_of([(i, t) for i, t, _ in cleaned], [(k, decontaminate.plain(t)) for k, t in items])
    left = [(i, t) for i, t, _ in cleaned if i not in {d for d, _ in leaky}]
    assert 10 < len(left) < len(cleaned) < len(want) + 1 < len(rows) and any(x != t for (_, x, _), (_, t, _) in zip(cleaned, want, strict=True))
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    ids = {i: x for (i, _), x in zip(left, reference_ids([t for _, t in left]), strict=True)}
    per_doc, _ = check_pieces(out, ids)
    assert set(per_doc) == set(ids)


def test_fitted_weights_on_real_pages(spark, sf):
    """Leaving out the learned weights, or the choice of a region, changes the text of most pages."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect() if r.html]
    weights = html.fit(pages[:30])
    own = [html.main_text(p, weights) for p in pages]
    assert np.mean([html.main_text(p, {}) != t for p, t in zip(pages, own, strict=True)]) > 0.9
