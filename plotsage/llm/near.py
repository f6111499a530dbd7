"""N-gram Jaccard join: MinHash bands find candidates, full sets of n-grams decide.

Texts of equal words are one node with many copies. Nodes that share a band hash are candidates; what candidates connect
is split into blocks of bounded size, and each pair of blocks is one group, in which the exact Jaccard similarity of
all its texts is a matrix product. A group returns sums of links and a spanning forest, never its pairs. Where candidates
make a long chain instead of a family, the texts of each band hash are such a group of their own, and a pair counts in the
first band that it shares.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import byte_table, cut, id_column, lists, mix64, numbers, pieces, powers, words
from plotsage.llm.graph import components

WIDTH, SIMILARITY = 5, 0.8
RECALL, ROWS = 0.9995, 6
#: Texts, and n-grams, of a block: bounds what one group holds (two blocks).
BLOCK_TEXTS, BLOCK_GRAMS = 256, 1 << 20
CHUNK = 4096
#: A component of more than one block goes by its band hashes if they hold so many times fewer pairs than the whole.
SPARSE = 4


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands of so many rows by which a pair of that similarity becomes a candidate with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def grams(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words of each text, and where each text's begin. Shorter texts are one run, if not empty."""
    n_words = np.diff(firsts)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    step = numbers(9, width)
    start = np.repeat(firsts[:-1] - ends[:-1], n) + np.arange(ends[-1])
    room = np.repeat(firsts[1:], n) - start
    out = np.zeros(ends[-1], np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        word = padded[start + k]
        out += np.where(room > k, word, 0).astype(np.uint64) * step[k] if room.min() < width else word * step[k]
    return mix64(out), ends


def signatures(shingles: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each text (its row), from minima under bands * rows hash functions. Texts must not be empty."""
    a, b = numbers(21, bands * rows) | np.uint64(1), numbers(22, bands * rows)
    n = len(ends) - 1
    out = np.empty((n, bands), np.uint64)
    low = shingles >> np.uint64(32)
    scratch = np.empty_like(shingles)
    for i in range(bands):
        acc = np.full(n, i + 1, np.uint64)
        for j in range(i * rows, (i + 1) * rows):
            np.multiply(low, a[j], out=scratch)
            scratch += b[j]
            scratch >>= np.uint64(32)
            acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(scratch, ends[:-1]))
        out[:, i] = acc
    return out


def digests(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each text's sequence of words."""
    at = np.arange(len(hashes)) - np.repeat(firsts[:-1], np.diff(firsts))
    found = []
    for seed, of in ((3, 0x2545F4914F6CDD1D), (4, 0x9FB21C651E98DF25)):
        terms = mix64(hashes ^ np.uint64(seed)) * powers(of, int(at.max()) + 1 if len(at) else 1)[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        found.append(mix64(sums[firsts[1:]] - sums[firsts[:-1]] + np.diff(firsts).astype(np.uint64)))
    return found[0], found[1]


def signed(docs: DataFrame, width: int, similarity: float, recall: float, rows: int) -> DataFrame:
    """docs with d1, d2 (digests), n_words and bands, for its column text, which comes last."""
    n_bands = bands_for(similarity, recall, rows)
    table = byte_table(lower=False)

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(batch.num_columns - 1)):
                hashes, _, _, firsts = words(data, offsets, table)
                n_words = np.diff(firsts)
                d1, d2 = digests(hashes, firsts)
                shingles, ends = grams(hashes, firsts, width)
                full = np.flatnonzero(np.diff(ends) > 0)
                bands = signatures(shingles, np.append(ends[full], ends[-1]), n_bands, rows) if len(full) else np.zeros((0, n_bands), np.uint64)
                begin = np.concatenate([[0], np.cumsum(np.where(np.diff(ends) > 0, n_bands, 0))])
                more = [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(n_words.astype(np.int64)), lists(bands.ravel().view(np.int64), begin)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns), *more], names=[f"c{i}" for i in range(batch.num_columns)] + ["d1", "d2", "n_words", "bands"])

    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    more = "d1 long, d2 long, n_words long, bands array<long>"
    schema = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    return inner.mapInArrow(run, f"{schema}, {more}")


def gram_sets(members: DataFrame, width: int) -> DataFrame:
    """node, comp, n_blocks, copies, nth, bands, and the sorted distinct n-grams of text, which comes last."""
    table = byte_table(lower=False)

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(batch.num_columns - 1)):
                hashes, _, _, firsts = words(data, offsets, table)
                shingles, ends = grams(hashes, firsts, width)
                sets = [np.unique(shingles[ends[i] : ends[i + 1]]) for i in range(to - at)]
                begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in batch.columns[:-1]), lists(values.view(np.int64), begin)], names=[*batch.schema.names[:-1], "grams"])

    return members.mapInArrow(run, "node long, comp long, n_blocks long, copies long, nth int, bands array<long>, grams array<long>")


def links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets reach the similarity, as a matrix."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    place = place[order]
    shared = np.zeros((n, n), np.float64)
    edges = np.searchsorted(place, np.arange(0, place[-1] + 1 + CHUNK, CHUNK))
    for k in range(len(edges) - 1):
        own, at = owner[edges[k] : edges[k + 1]], place[edges[k] : edges[k + 1]] - k * CHUNK
        if len(own):
            rows = np.unique(own)
            flags = np.zeros((len(rows), CHUNK), np.float32)
            flags[np.searchsorted(rows, own), at] = 1
            shared[np.ix_(rows, rows)] += flags @ flags.T
    near = shared >= similarity / (1 + similarity) * (sizes[:, None] + sizes[None, :]) - 1e-9
    np.fill_diagonal(near, False)
    return near


def roots(near: np.ndarray) -> np.ndarray:
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def verify(similarity: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        across = key[2].as_py() != key[3].as_py()  # of two blocks only pairs across count, even if one is empty
        comp, node, block, copies, nth = (table.column(c).to_numpy() for c in ("comp", "node", "block", "copies", "nth"))
        grams_, bands_ = table.column("grams").combine_chunks(), table.column("bands").combine_chunks()
        values, begin = grams_.flatten().to_numpy(), np.concatenate([[0], np.cumsum(grams_.value_lengths().to_numpy())])
        band_values, band_begin = bands_.flatten().to_numpy(), np.concatenate([[0], np.cumsum(bands_.value_lengths().to_numpy())])
        out_node, out_root, out_links = [], [], []
        order = np.argsort(comp, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            if len(rows) < 2 or across and block[rows].min() == block[rows].max():
                continue
            near = links([values[begin[i] : begin[i + 1]] for i in rows], similarity)
            if across:
                near &= block[rows][:, None] != block[rows][None, :]
            if (before := nth[rows[0]]) > 0:  # a pair that shares an earlier band counts there
                bands = np.stack([band_values[band_begin[i] : band_begin[i] + before] for i in rows])
                for j in range(before):
                    near &= bands[:, j, None] != bands[None, :, j]
            hit = np.flatnonzero(near.any(1))
            out_node.append(node[rows[hit]])
            out_root.append(node[rows[roots(near)[hit]]])
            out_links.append((near @ copies[rows])[hit])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"node": join(out_node), "root": join(out_root), "links": join(out_links)})

    return run


def placed(sized: DataFrame, banded: DataFrame) -> tuple[DataFrame, int]:
    """node, row, comp, n_blocks, nth and bands of each text to be verified, and in how many packs small groups go.

    sized: node, row, comp, n_words of the texts of all candidate components. Components of one block, and families, are
    groups as they are. Chains, whose band hashes hold far fewer pairs than the whole, make a group of each band hash;
    comp is the hash's then, nth the band's number, and bands the text's bands."""
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_words") / BLOCK_GRAMS)).alias("n_blocks")
    measured = [blocks, F.count("*").alias("n"), F.sum("n_words").alias("words")]
    comps = cut(sized.groupBy("comp").agg(*measured), "near-comps")
    none = F.array().cast("array<bigint>").alias("bands")
    big = comps.filter("n_blocks > 1")
    in_big = sized.join(big.select("comp"), "comp").join(banded.select("node", "bands"), "node").select("comp", "node", "row", "n_words", "bands", F.posexplode("bands").alias("nth", "band"))
    work = in_big.groupBy("comp", "nth", "band").agg(F.count("*").alias("n")).groupBy("comp").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    chains = cut(big.join(work, "comp").filter(F.col("work") * SPARSE < F.col("n") * F.col("n")).select("comp"), "near-chains")
    whole = comps.join(chains, "comp", "left_anti")
    each = in_big.join(chains, "comp", "left_semi").withColumn("comp", F.xxhash64("comp", "nth", "band"))
    hashes = cut(each.groupBy("comp").agg(*measured).filter("n > 1"), "near-hashes")
    out = sized.join(whole.select("comp", "n_blocks"), "comp").select("node", "row", "comp", "n_blocks", F.lit(0).alias("nth"), none)
    out = out.unionByName(each.join(hashes.select("comp", "n_blocks"), "comp").select("node", "row", "comp", "n_blocks", "nth", "bands"))
    small = whole.unionByName(hashes).filter("n_blocks = 1").agg(F.sum("n"), F.sum("words")).first()
    return out, max((small[0] or 0) // BLOCK_TEXTS, (small[1] or 0) // BLOCK_GRAMS) + 1


def group(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The columns of docs by place (c0, c1, ...) and class_id, n_links and kept.

    A class is what links of at least that Jaccard similarity between sets of width-word n-grams connect; class_id is
    its least doc_id, n_links the number of other rows that a row is linked to, copies of its own words included, and
    kept marks one row of each class, that of least doc_id. Texts of fewer words are one n-gram. Null and empty texts are
    classes of their own without links, and kept. A null doc_id comes after all others. Repeated rows are copies. Columns
    beside doc_id and text may have any name. An empty table gives an empty result.
    """
    names = docs.columns
    kind = id_column(docs)[1]
    at_text = f"c{names.index('text')}"
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    rest = [c for c in inner.columns if c != at_text]
    # the text comes last, where signed() looks for it
    own = inner.select(*rest, F.col(f"c{names.index('doc_id')}").cast(kind).alias("id"), at_text)
    done = cut(signed(own, width, similarity, recall, rows).toDF(*rest, "id", at_text, "d1", "d2", "n_words", "bands").withColumn("row", F.monotonically_increasing_id()), "near-signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = done.filter("n_words > 0").groupBy("d1", "d2").agg(first, F.count("*").alias("copies"), F.min("row").alias("row"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    # candidates: those that share a band hash are joined to the least of them
    banded = cut(nodes.select("node", "row").join(done.select("row", "bands", "n_words"), "row"), "near-bands")
    each = banded.select("node", F.explode("bands").alias("band"))
    leads = cut(each.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1").select("band", "lead"), "near-leads")
    pairs = each.join(leads, "band").filter("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    apart = components(pairs)
    members = apart.unionByName(apart.select(F.col("root").alias("node"), "root").distinct())
    sized = cut(members.withColumnRenamed("root", "comp").join(banded.select("node", "row", "n_words"), "node"), "near-members")
    to_verify, n_packs = placed(sized, banded)

    # verification: texts of a group meet by pairs of blocks; small groups share packs
    texts = to_verify.join(nodes.select("node", "copies"), "node").join(done.select("row", F.col(at_text).alias("text")), "row").select("node", "comp", "n_blocks", "copies", "nth", "bands", "text")
    sets = gram_sets(texts, width)
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    met = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    met = met.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    met = met.withColumn("packed", F.col("n_blocks") == 1).withColumn("pack", F.when(F.col("packed"), F.pmod(F.xxhash64("comp"), F.lit(n_packs))).otherwise(F.col("comp")))
    found = cut(met.groupBy("packed", "pack", "lo", "hi").applyInArrow(verify(similarity), "node long, root long, links long"), "near-found")

    tied = components(found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    rooted = nodes.join(tied, "node", "left").select("node", "d1", "d2", "first", "copies", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted, "near-rooted")
    classes = cut(rooted.groupBy("root").agg(F.min("first").alias("head")), "near-classes")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    keyed = rooted.join(counts, "node", "left").join(classes, "root")
    keyed = cut(keyed.select("d1", "d2", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-keyed")
    # empty texts have no class to look up; their digests are all the same, which is no key to join by
    wordless = done.filter("n_words = 0").withColumns({"head": F.lit(None).cast(keyed.schema["head"].dataType), "n_links": F.lit(0).cast("long")})
    worded = done.filter("n_words > 0").join(keyed, ["d1", "d2"], "left")
    alone = F.col("head").isNull()
    columns = [*inner.columns, F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("head.row") == F.col("row"))).alias("kept")]
    return worded.select(*columns).unionByName(wordless.select(*columns))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links and kept of each row of docs; see group()."""
    return group(docs.select("doc_id", "text"), **options).select(F.col("c0").alias("doc_id"), "class_id", "n_links", "kept")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that group() keeps, one of each class, with all their columns."""
    found = group(docs, **options).filter("kept")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
