"""Near copies, repeated passages, decontamination, nearest neighbours, components, and the pipeline."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotsage.llm import decontaminate, graph, hamming, near, substring

BLANK = r"[\x20\x09-\x0D]+"


def same(got, want):
    assert collections.Counter(got) == collections.Counter(want)


def vocabulary(draw, n=3000):
    return ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(draw.randrange(2, 9))) for _ in range(n)]


# --- components ---------------------------------------------------------------------------------------------------------


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301), (302, 301)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {301: 300, 302: 300}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- near copies ------------------------------------------------------------------------------------------------------------


def classes(rows, width=5, similarity=0.8):
    def grams(t):
        w = [x for x in re.split(BLANK, t or "") if x]
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    where = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n_links = [0] * len(rows)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in where[x])
        for j, k in shared.items():
            if j != i and k >= similarity * (len(s) + len(sets[j]) - k):
                n_links[i] += 1
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(ids, default=None), n_links[i]) for i in members]
    return out, len(groups)


@pytest.fixture(scope="module")
def copies(spark, corpus):
    draw = random.Random(5)
    rows = []
    base = [f"q{draw.randrange(300)}" for _ in range(150)]
    for i in range(70):
        w = list(base)
        for _ in range(draw.randrange(1, 5)):
            w[draw.randrange(150)] = f"z{draw.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, "a b"), (2001, "a  b"), (2002, "a b c"), (None, "a b c d e f")]
    return corpus.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_equal_brute_force(copies, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK_TEXTS", block)
    want, n = classes([tuple(r) for r in copies.collect()])
    got = near.near_copies(copies).collect()
    same([(r.doc_id, r.class_id, r.n_links) for r in got], want)
    assert sum(r.kept for r in got) == n


def test_chains_of_candidates_go_by_their_bands(spark, copies, monkeypatch):
    """Each text shares words with the next: a long chain of candidates, few of them near. Links are those of brute force,
    by whole components and by band hashes, and a pair that shares several bands counts once."""
    draw = random.Random(18)
    v = vocabulary(draw, 3000)
    run = [draw.choice(v) for _ in range(3000)]
    rows = [(i, " ".join(run[9 * i : 9 * i + (60 if i % 5 else 64)])) for i in range(300)] + [(1000 + i, " ".join(run[90 * i : 90 * i + 58])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(copies.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    want, _ = classes([tuple(r) for r in df.collect()])
    monkeypatch.setattr(near, "BLOCK_TEXTS", 8)
    for sparse in (4, 1e-9):
        monkeypatch.setattr(near, "SPARSE", sparse)
        same([(r.doc_id, r.class_id, r.n_links) for r in near.near_copies(df).collect()], want)


def test_blocks_that_stay_empty_count_nothing_twice(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_GRAMS", 300)
    draw = random.Random(19)
    words = [draw.choice(vocabulary(draw, 500)) for _ in range(400)]
    rows = [(i, " ".join(words[:-1] + [f"end{i}"])) for i in range(3)]
    got = near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(0, 0, 2), (1, 0, 2), (2, 0, 2)]


def test_representatives_keep_columns(corpus, nothing):
    kept = near.representatives(corpus)
    assert kept.columns == corpus.columns and kept.filter("doc_id = 0").count() == 1 and kept.filter("doc_id between 200 and 229").count() == 0
    assert near.near_copies(nothing).count() == 0 and near.representatives(nothing).count() == 0


def test_bands_reach_their_recall():
    n = near.bands_for(0.8, 0.9995, 6)
    assert 1 - (1 - 0.8**6) ** n >= 0.9995 > 1 - (1 - 0.8**6) ** (n - 1)
    draw = np.random.default_rng(3)
    hit = 0
    for _ in range(60):
        shared, a, b = (draw.integers(0, 2**63, k).astype(np.uint64) for k in (80, 10, 10))
        both = np.concatenate([shared, a, shared, b])
        s = near.signatures(near.mix64(both), np.array([0, 90, 180]), n, 6)
        hit += (s[0] == s[1]).any()
    assert hit == 60


# --- repeated passages ----------------------------------------------------------------------------------------------------------


def test_repeated_passages(spark, corpus):
    draw = random.Random(4)
    v = vocabulary(draw)
    prose = lambda n: " ".join(draw.choice(v) for _ in range(n))
    rows, planted, clean = [], [], []
    for k in range(60):
        p = prose(draw.randrange(51, 80))
        for j in range(2):
            rows.append((2 * k + j, prose(draw.randrange(200)) + " " + p + " " + prose(draw.randrange(90))))
            planted.append((2 * k + j, p))
    for k in range(80):
        rows.append((1000 + k, prose(100) + " " + " ".join(v[:10]) + " " + prose(50)))
        clean.append(1000 + k)
    found = {r.doc_id: r.spans for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not set(clean) & set(found)
    text = dict(rows)
    for d, p in planted:
        at = text[d].index(p)
        assert any(s.start < at + len(p) and at < s.end for s in found[d])
        assert all(s.words <= len(p.split()) + 2 for s in found[d])
    # of two copies one is kept
    assert all([s.copy for s in found[2 * k]] != [s.copy for s in found[2 * k + 1]] for k in range(60))
    awkward = substring.digest(substring.repeats(corpus)).collect()
    ids = collections.Counter(r.doc_id for r in awkward)
    assert ids[100] == ids[101] == ids[103] == 0 and all(ids[i] for i in (0, 200, 229, 105))


def test_copies_beside_first_passages_are_told_apart(spark):
    draw = random.Random(8)
    v = vocabulary(draw)
    p, r = (" ".join(draw.choice(v) for _ in range(80)) for _ in range(2))
    rows = [(0, p), (1, p + " " + r), (2, p + " " + r)]
    found = {x.doc_id: x.spans for x in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert [s.copy for s in found[0]] == [False] and [s.copy for s in found[2]] == [True]
    first, rest = found[1]
    assert first.copy and not rest.copy and first.end == rest.start
    assert first.start == 0 and 0 <= len(p) - first.end <= 2 * substring.MOST and rest.end == len(rows[1][1])
    assert abs(first.words + rest.words - 160) <= 20


def touching(spans):
    """Spans in order, those that follow each other without a gap as one."""
    whole = []
    for start, end in spans:
        if whole and start == whole[-1][1]:
            whole[-1] = (whole[-1][0], end)
        else:
            whole.append((start, end))
    return whole


def test_spans_equal_plain_pairs_of_chunks(spark):
    """Chunks, their pairs as texts, and stretches of pairs that occur twice and more, with dictionaries."""
    draw = random.Random(20)
    v = vocabulary(draw, 300)
    prose = lambda n: " ".join(draw.choice(v) for _ in range(n))
    shared = [prose(draw.randrange(8, 90)) for _ in range(12)]
    rows = [(i, " ".join(prose(draw.randrange(30)) if draw.random() < 0.5 else draw.choice(shared) for _ in range(8))) for i in range(60)]
    points = np.array([ord(c) for _, t in rows for c in t], np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    ends, per_text = substring.boundaries(points, begins, substring.BITS, substring.LEAST, substring.MOST)
    pairs_, at = {}, 0
    for (d, t), n, b in zip(rows, per_text, begins, strict=False):
        cuts = [0, *(int(e - b) for e in ends[at : at + n])]
        at += n
        pairs_[d] = [(cuts[i], cuts[i + 1], cuts[i + 2]) for i in range(len(cuts) - 2)] or [(0, len(t), len(t))]
    times = collections.Counter(rows[d][1][a:c] for d, found in pairs_.items() for a, _, c in found)
    want = {}
    for d, found in pairs_.items():
        runs = []
        for a, m, c in (p for p in found if times[rows[d][1][p[0] : p[2]]] > 1):
            if runs and a <= runs[-1][1]:
                runs[-1][1:] = [m, c]
            else:
                runs.append([a, m, c])
        starts = lambda a, c, t=rows[d][1]: sum(not t[i].isspace() and (i == 0 or t[i - 1].isspace()) for i in range(a, c))
        kept = [(a, c) for a, _, c in runs if starts(a, c) >= substring.MIN_WORDS or c - a >= substring.MIN_CHARS]
        if kept:
            want[d] = touching(kept)
    got = {}
    for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] = touching([(s.start, s.end) for s in r.spans])
    assert got == want


def test_repeats_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.repeats(none).count() == 0 and substring.digest(substring.repeats(none)).count() == 0


def test_chunks_are_those_of_a_rolling_hash():
    draw = random.Random(6)
    texts = ["".join(draw.choice("abcdeé \n😀") for _ in range(draw.randrange(0, 900))) for _ in range(30)]
    number = lambda c: int(substring.mix64(np.array([ord(c) + 1], np.uint64))[0] >> np.uint64(32))
    want = []
    for t in texts:
        h, last, ends = 0, 0, []
        for i, c in enumerate(t, 1):
            h = ((h << 1) + number(c)) & 0xFFFFFFFF
            if h >> 28 == 0:
                while i - last > 128:
                    last += 128
                    ends.append(last)
                if i - last >= 12:
                    ends.append(i)
                    last = i
        while len(t) - last > 128:
            last += 128
            ends.append(last)
        if len(t) > last:
            ends.append(len(t))
        want.append(ends)
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ends, per_text = substring.boundaries(points, begins, 4, 12, 128)
    got = [list(e - b) for e, b in zip(np.split(ends, np.cumsum(per_text)[:-1]), begins, strict=False)]
    assert got == want


# --- decontamination -----------------------------------------------------------------------------------------------------------------


def test_overlaps_equal_brute_force(spark, corpus):
    draw = random.Random(2)
    v = vocabulary(draw, 400)
    prose = lambda n: " ".join(draw.choice(v) for _ in range(n))
    items = [(i, prose(draw.randrange(14, 60))) for i in range(25)] + [(100, "tiny Item here"), (101, None), (102, ""), (3, prose(20))]
    rows = []
    for i in range(120):
        w = draw.choice(items[:25])[1].split()
        for j in draw.sample(range(len(w)), int(len(w) * draw.choice([0, 0.1, 0.15, 0.3]))):
            w[j] = "zzz"
        rows.append((i, "é😀 lorem " * draw.randrange(9) + " ".join(w[draw.choice([0, 0, 20]) :]) + " dolor"))
    rows += [(500, "x tiny, ITEM here! y"), (None, "tiny item here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(corpus.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit(1))
    tokens = lambda t: re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", (t or "").lower())
    want = set()
    for d, t in [tuple(r) for r in docs.collect()]:
        mine = tokens(t)
        for item, it in items:
            theirs = tokens(it)
            width = min(13, len(theirs))
            for shift in range(-len(theirs) + 1, len(mine) if theirs else 0) if len(mine) < 3000 else ():
                lo, hi = max(0, -shift), min(len(theirs), len(mine) - shift)
                if hi - lo < width:
                    continue
                flags = [mine[i + shift] == theirs[i] for i in range(lo, hi)]
                if max(sum(flags[i : i + width]) for i in range(len(flags) - width + 1)) >= 0.8 * width - 1e-9:
                    want.add((d, item))
                    break
    found = decontaminate.leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == want
    assert (500, 100) in got and (None, 100) in got
    text = {r.doc_id: r.text for r in docs.collect()}
    a, b = map(int, next(r.spans for r in found if r.doc_id == 500).split(":"))
    assert text[500][a:b] == "tiny, ITEM here"
    clean = decontaminate.clean(docs.withColumn("segment", F.lit(1)), bench)
    assert clean.columns == [*docs.columns, "segment"] and {r.doc_id for r in clean.collect()} - {None} == set(text) - {d for d, _ in got} - {None}


@pytest.mark.parametrize("similarity", [0.8, 0.7])
def test_short_items_are_found_whatever_is_substituted(spark, similarity):
    """Every allowed substitution of items of 1 to 13 tokens; one more is no overlap."""
    items, rows = [], []
    for n in range(1, 14):
        words = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        most = math.floor((1 - similarity) * n + 1e-9)
        for gone in range(most + 2):
            for at in itertools.combinations(range(n), gone):
                rows.append((len(rows), "before it " + " ".join("zzz" if i in at else w for i, w in enumerate(words)) + " after it", n if gone <= most else None))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), similarity=similarity).collect()}
    assert found == {(d, n) for d, _, n in rows if n}


def test_one_word_repeated_very_often(spark):
    docs = spark.createDataFrame([(1, "again " * 20_000), (2, "no " * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "again " * 15)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_decontamination_of_empty_tables(corpus, nothing, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "item_id long, text string")
    assert decontaminate.leaks(nothing, bench).count() == 0
    assert decontaminate.leaks(corpus, bench.limit(0)).count() == 0
    assert decontaminate.clean(corpus, bench.limit(0)).count() == corpus.count()


def test_items_without_id_count_and_columns_stay(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(None, passage), (None, "another item of no id that no text of the table holds at all today"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"here {passage} there", "a"), (2, "clean " * 30, "b"), (None, None, None)], "doc_id long, text string, _row string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()] == [(1, None)]
    same([tuple(r) for r in decontaminate.clean(docs, bench).collect()], [(2, "clean " * 30, "b"), (None, None, None)])


# --- nearest neighbours -----------------------------------------------------------------------------------------------------------------


def vectors(spark, n=1500, dim=32, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(60, dim))
    x = centres[draw.integers(0, 60, n)] + 0.35 * draw.normal(size=(n, dim))
    rows = [(i, [float(c) for c in row]) for i, row in enumerate(x)]
    rows += [(5000, None), (5001, []), (5050, [0.0] * dim), (5002, [float("nan")] * dim), (5003, [None] * dim), (None, rows[0][1]), (5100, [1.0]), (6000, rows[0][1]), (6001, rows[0][1]), (6001, rows[0][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")), {i: np.array(v) for i, v in rows if i is not None and v and len(v) == dim and i not in (5050, 5002, 5003)}


def test_neighbours_recall_and_scores(spark):
    df, known = vectors(spark)
    ids = np.array(sorted(known))
    x = np.stack([known[i] / np.linalg.norm(known[i]) for i in ids])
    got = collections.defaultdict(list)
    for r in hamming.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    queries_ = [i for i in ids if i % 50 == 0]
    assert set(got) == set(queries_)
    hit = 0
    for q in queries_:
        score = x @ x[np.searchsorted(ids, q)]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:5]
        hit += len({int(ids[j]) for j in order} & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1)) and q not in [v for _, v, _ in got[q]]
        for _, v, s in got[q]:
            assert s == pytest.approx(score[np.searchsorted(ids, v)], abs=1e-12)
        assert got[q] == sorted(got[q], key=lambda r: (-round(r[2], 12), r[1]))
    assert hit / (5 * len(queries_)) >= 0.9
    assert [v for _, v, _ in got[0]][:2] == [6000, 6001]  # ties go to the smaller id, and an id counts once


def test_probing_finds_every_code_within_the_radius():
    draw = np.random.default_rng(4)
    codes, queries_ = draw.integers(0, 1 << 16, (3000, 4)).astype(np.uint16), draw.integers(0, 1 << 16, (20, 4)).astype(np.uint16)
    codes[:40] = np.repeat(queries_[:20], 2, axis=0) ^ (draw.random((40, 4)) < 0.5).astype(np.uint16)
    for radius in (0, 3, 7, 14, 22):
        for q, found in zip(queries_, hamming.probe(queries_, codes, radius), strict=True):
            assert set(found) == set(np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius))


@pytest.mark.parametrize("width", [16, 20])
def test_index_join_finds_every_code_within_the_radius(spark, width):
    """The join on substring and value, and blocks, retrieve the same: all within the radius."""
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(30, 16))
    x = centres[np.arange(600) % 30] + 0.1 * draw.normal(size=(600, 16))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, v array<double>")
    model = hamming.Codes(hamming.unit(x), 5)
    bits = model.bits(hamming.unit(x))
    for radius in (0, 4, 7):
        got = {(r.query_id, r.vec_id): r.score for r in hamming.by_index(df, df.filter("vec_id % 20 = 0"), model, width, radius).collect()}
        apart = (bits[:, None, :] != bits[None, ::20, :]).sum(2)
        assert set(got) == {(20 * q, v) for v, q in zip(*np.nonzero(apart <= radius), strict=True) if v != 20 * q}
        cosine = hamming.unit(x) @ hamming.unit(x).T
        assert all(abs(s - cosine[q, v]) < 1e-12 for (q, v), s in got.items())


def test_clusters_are_searched_by_the_index(spark, monkeypatch):
    draw = np.random.default_rng(10)
    centres = draw.normal(size=(200, 32))
    rows = [(i, (centres[i % 200] + 0.02 * draw.normal(size=32)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    used = []
    monkeypatch.setattr(hamming, "MOST_PROBES", 20_000)
    monkeypatch.setattr(hamming, "by_index", lambda *a, of=hamming.by_index: used.append(a[-1]) or of(*a))
    monkeypatch.setattr(hamming, "INDEX_SHARE", 0)
    got = hamming.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    assert used
    x = hamming.unit(np.array([r for _, r in rows]))
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    hit = sum(r.vec_id in np.argsort(-cosine[r.query_id])[:5] for r in got)
    assert len(got) == 5 * 80 and hit / len(got) > 0.95


def test_recall_on_the_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = hamming.unit(np.array(df.orderBy("vec_id").toPandas()["embedding"].tolist(), float))
    ids = np.array([r[0] for r in df.select("vec_id").orderBy("vec_id").collect()])
    got = hamming.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    cosine = x @ x.T
    np.fill_diagonal(cosine, -1)
    best = {int(ids[i]): set(ids[np.argsort(-cosine[i])[:5]].tolist()) for i in np.flatnonzero(ids % 50 == 0)}
    assert len(got) == 5 * len(best)
    assert sum(r.vec_id in best[r.query_id] for r in got) / len(got) >= 0.95


def test_very_many_equal_vectors(spark):
    df = spark.range(20_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("embedding"))
    got = [r.vec_id for r in hamming.nearest(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [3, 6, 9, 12, 15]


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in hamming.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert hamming.nearest(few.limit(0), few.limit(0)).count() == 0


def test_queries_apart_from_all_others_are_served(spark):
    """Tight clusters make a small radius; lone vectors lie outside of it and still get their neighbours."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 32))
    rows = [(i + 1000, (centres[i % 40] + 0.01 * draw.normal(size=32)).tolist()) for i in range(1200)]
    lone = [(50 * (i + 1), draw.normal(size=32).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows + lone, "vec_id long, embedding array<double>")
    found = hamming.nearest(df, df.filter("vec_id < 1000")).toPandas()
    assert found.groupby("query_id")["rank"].apply(lambda r: sorted(r) == [1, 2, 3, 4, 5]).to_dict() == {q: True for q, _ in lone}
    assert not found.duplicated(["query_id", "vec_id"]).any()


# --- pipeline -----------------------------------------------------------------------------------------------------------------------------


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


def test_pipeline_keeps_its_promises(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(kept, kept[1:], strict=False)) and kept[2] == kept[3] and len(kept[-1]) > 50
    rows = [tuple(r) for r in docs.collect()]
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r[1] or "") for r in rows)
    assert decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    mixed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in mixed} == kept[-1]
