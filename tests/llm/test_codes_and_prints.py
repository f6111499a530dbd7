"""Vector codes, fill-in-the-middle and fingerprints: against DuckDB, plain Python, and on awkward input."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plotsage.llm import infill, quantise, queries, spotsigs

ALONE = """
from pyspark.sql import SparkSession
from plotsage.llm import common, quantise
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert common.shared_folder(spark) == common.shared_folder(spark)
vectors = spark.createDataFrame([(i, i % 2, [float(i)] * 8) for i in range(20)], "vec_id long, label int, embedding array<double>")
assert quantise.digest(*quantise.compress(vectors)).count() == 20
"""


def test_tables_are_cut_without_any_setting(tmp_path):
    """A Spark of its own, with an empty folder of settings."""
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", ALONE], cwd=tmp_path, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_in_middle", "op13_spot_signatures"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert collections.Counter(tuple(r) for r in got.select(columns).collect()) == collections.Counter(want) and want


# --- fill in the middle ----------------------------------------------------------------------------------------------


def plain_transform(doc_id, text):
    text = text or ""
    units = re.findall(rf"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain_python(spark, corpus):
    draw = random.Random(8)
    bits = ["a", "é😀", " ", "\n\t", "<P", ">", "<", "S>", "word", " ", "<M>", "x" * 300]
    rows = [(i, "".join(draw.choice(bits) for _ in range(draw.randrange(80)))) for i in range(400)] + [(1000, "é " * 3000), (1001, "y" * 9000), (1002, " " * 5000 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(corpus.select("doc_id", "text"))
    got = infill.transform(docs).withColumn("again", infill.restored(F.col("form"), F.col("output"))).collect()
    want = [(d.doc_id, *plain_transform(d.doc_id, d.text), d.text or "") for d in docs.collect()]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_infill_leaves_clashing_columns_and_empty_tables(corpus, nothing):
    assert infill.digest(infill.transform(corpus)).count() == corpus.count()
    assert infill.digest(infill.transform(nothing)).collect() == []


def test_fenwick_descent_finds_each_block():
    counts = np.array([[draw % 5, draw % 7] for draw in range(37)])
    tree = infill.Fenwick(counts)
    ends = np.cumsum(counts[:, 0])
    assert tree.total() == ends[-1]
    for k in range(1, ends[-1] + 1):
        block = int(np.searchsorted(ends, k))
        assert tree.block_of(k) == (block, counts[:block, 0].sum(), counts[:block, 1].sum())


# --- vector codes ----------------------------------------------------------------------------------------------------


def test_gnat_finds_the_nearest_and_rules_out_the_rest(monkeypatch):
    draw = np.random.default_rng(1)
    for n, dim, reach in ((1, 3, 9), (4, 2, 2), (16, 8, 3), (16, 8, 4000), (200, 2, 900), (64, 1, 5), (30, 4, 1 << 26)):
        entries, x = draw.integers(-reach, reach + 1, (n, dim)), draw.integers(-reach, reach + 1, (3000, dim))
        apart = ((x[:, None] - entries) ** 2).sum(2)
        index, best = quantise.Gnat(entries).nearest(x)
        assert (index == apart.argmin(1)).all() and (best == apart.min(1)).all()
    clustered = np.repeat(draw.integers(-4000, 4000, (16, 2)), 8, axis=0) + draw.integers(-5, 5, (128, 2))
    tree, measured = quantise.Gnat(clustered), []
    monkeypatch.setattr(quantise, "squared", lambda x, entry, of=quantise.squared: measured.append(len(x)) or of(x, entry))
    tree.nearest(clustered[:100] + 1)
    assert sum(measured) < 0.3 * 100 * 128


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, l, [int(np.floor(4096 * float(x))) for x in v]) for i, l, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = [[tuple(c[j * width : j * width + width]) for j in range(parts)] for _, _, c in kept]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda j, p: min((apart(p, e), i) for i, e in enumerate(books[j]))
    for _ in range(rounds):
        held = [collections.defaultdict(list) for _ in range(parts)]
        for c in cut:
            for j, p in enumerate(c):
                held[j][nearest(j, p)[1]].append(p)
        for j in range(parts):
            for i, of in held[j].items():
                books[j][i] = tuple(sum(p[k] for p in of) // len(of) for k in range(width))
    last = [[nearest(j, p) for j, p in enumerate(c)] for c in cut]
    return [(r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)) for r, found in zip(kept, last, strict=True)], books


def test_codes_equal_plain_python(spark):
    draw = random.Random(2)
    rows = [(i, i % 3 if i % 5 else None, [draw.uniform(-1, 1) * (i % 4) for _ in range(16)]) for i in range(60)]
    rows += [rows[7], rows[8], rows[8]] + [(None, 1, [0.25] * 16), (900, None, None), (901, 1, [None] * 16), (902, 1, [float("nan")] * 16), (903, 1, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, c string, code int")
    coded, books = quantise.compress(df)
    want, want_books = plain_codes(rows)
    got = quantise.digest(coded, books).collect()
    assert collections.Counter((r.vec_id, r.code, r.error) for r in got) == collections.Counter(want)
    assert [[tuple(e) for e in b] for b in books] == want_books
    for label in (None, 0, 1, 2):
        assert {r.label_error for r in got if r.label == label} == {sum(r.error for r in got if r.label == label)}


def test_codes_of_few_and_strange_vectors(spark):
    schema = "vec_id long, label int, embedding array<double>"
    assert quantise.digest(*quantise.compress(spark.createDataFrame([], schema))).collect() == []
    few = spark.createDataFrame([(1, 1, [1e300] * 8), (2, 1, [-1e300] * 8), (3, 1, [0.5] * 8), (4, 1, [0.5] * 9), (5, 1, [])], schema)
    got = {r.vec_id: r for r in quantise.digest(*quantise.compress(few)).collect()}
    assert got.keys() == {1, 2, 3} and {r.error for r in got.values()} == {0} and len({r.code for r in got.values()}) == 3


# --- fingerprints ----------------------------------------------------------------------------------------------------


def plain_print(text, common, chain=3):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    content = [i for i, x in enumerate(w) if x not in common]
    found = set()
    for i, x in enumerate(w):
        after = [w[j] for j in content if j > i][:chain]
        if x in common and len(after) == chain:
            found.add(" ".join([x, *after]))
    found = found or {" ".join(w[i : i + chain]) for i in range(max(len(w) - chain, 0) + 1)}
    return {hashlib.md5(x.encode()).hexdigest()[:12] for x in found}


def near(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("range_bytes", [1 << 20, 3000])
def test_fingerprints_equal_plain_python(spark, corpus, range_bytes):
    docs = [(r.doc_id, r.text or "") for r in corpus.select("doc_id", "text").collect() if len(r.text or "") < 20_000]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, range string, sigs int")
    counts = collections.Counter(w for _, t in docs for w in re.split(r"[\W_]+", t.lower()) if w)
    common = {w for w, n in counts.items() if n * spotsigs.ANCHOR_SHARE >= sum(counts.values())}
    assert spotsigs.anchors(df) == sorted(common)
    got = spotsigs.digest(spotsigs.edits(df, range_bytes=range_bytes)).collect()
    assert len(got) == len(docs)
    falling = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    want = []
    for (doc_id, text), (_, after) in zip(falling, falling[1:] + falling[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = (plain_print(x, common) for x in (text, edited, after))
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(sorted(own)), ",".join(sorted(other)), near(own, other), near(own, following)))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_fingerprints_of_few_documents(spark):
    schema = "doc_id long, text string"
    assert spotsigs.digest(spotsigs.edits(spark.createDataFrame([], schema))).collect() == []
    one = spotsigs.digest(spotsigs.edits(spark.createDataFrame([(5, "abcd")], schema))).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    rows = spotsigs.digest(spotsigs.edits(spark.createDataFrame([(None, None), (None, ""), (1, ""), (-(1 << 63), "x")], schema))).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows if r.n_chars == 0}) == 1


def test_long_texts_are_read_whole(spark):
    runs = [f"the w{i} v{i} u{i}" for i in range(20_000)]
    got = spotsigs.digest(spotsigs.edits(spark.createDataFrame([(1, " ".join(runs)), (2, " ".join(runs[:10_000]))], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert got[0].fingerprint.count(",") == 19_999 and got[0].near_next == 0.5


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_linked_equals_brute_force(spark, similarity):
    draw = random.Random(6)
    sets = [sorted({f"s{draw.randrange(40)}" for _ in range(draw.randrange(1, 30))}) for _ in range(120)]
    sets += [sorted(set(s) - {draw.choice(s)} | {f"t{i}"}) for i, s in enumerate(sets) if len(s) > 3]
    sets += [[f"u{j}" for j in range(i)] for i in range(1, 40)]
    df = spark.createDataFrame(list(enumerate(sets)), "node long, sigs array<string>")
    got = {(r.u, r.v): r.likeness for r in spotsigs.linked(df, similarity).collect()}
    want = {(i, j): near(set(a), set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and near(set(a), set(b)) >= similarity}
    assert got == want and len(want) > 50


def test_near_documents_are_classes_and_links(spark):
    base = " ".join(f"the word{i} of text{i}" for i in range(60))
    rows = [(1, base), (2, base + " and more here now"), (3, base), (4, "the other of all things and much else"), (5, None), (6, ""), (None, base)]
    members, links = spotsigs.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), common=["and", "of", "the"])
    assert {r.doc_id: r["class"] for r in members.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}
    assert {(r.a, r.b) for r in links.collect()} == {(1, 2)}
