"""Nearest neighbours by multi-index hashing.

Vectors become binary codes by learned rotations. Codes are split into substrings, and each substring is indexed. Two
codes within a Hamming radius r agree, in one of m substrings at least, to within about r / m bits (pigeonhole), so
probing each substring's index that far retrieves every code within r. What is retrieved is ranked by its floats.

Rotations and radius are fitted on a bounded sample; every vector is indexed. Where the radius is small beside the code, as
in clustered vectors, the index is one table of (substring, value) rows: queries send a row for each value that they probe,
and both meet by an equi-join, so that work follows what is near. Where neighbours lie so far apart that the probes would
touch a good part of all values, vectors are dealt to blocks by hash, each block holds the indexes of its own vectors, and
blocks of queries visit it. Queries for which the radius holds too few codes ask again with a wider one.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotsage.llm.common import cut

#: Vectors that rotations and radius are fitted on (those of the smallest hashes of their id), and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
#: Bits of a code for each dimension, bits of a substring within a block, and the share of true neighbours the radius must hold.
BITS_PER_DIMENSION, SUBSTRING, SHARE = 4, 16, 0.97
BLOCK_ROWS, BLOCK_QUERIES = 8192, 4096
#: Bits of a substring of the index over all vectors, by their number; and the most values that a query may probe there.
WIDTHS, MOST_PROBES = (16, 28), 4096
#: The index is asked only if a query's probes are fewer than one in so many vectors.
INDEX_SHARE = 16


class Codes:
    """Rotation and radius: iterative quantisation, after centring, of unit vectors."""

    def __init__(self, sample: np.ndarray, neighbours: int, rounds: int = 25, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.mean = sample.mean(0) if len(sample) else np.zeros(self.dim)
        n_bits = max(SUBSTRING, -(-self.dim * BITS_PER_DIMENSION // SUBSTRING) * SUBSTRING)
        z = sample - self.mean
        parts = []
        while sum(p.shape[1] for p in parts) < n_bits:  # each round of dim bits has a rotation of its own
            r = np.linalg.qr(draw.normal(size=(self.dim, self.dim)))[0]
            for _ in range(rounds if len(z) else 0):
                u, _, vt = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
                r = (u @ vt).T
            parts.append(r)
        self.rotation = np.concatenate(parts, axis=1)[:, :n_bits]
        self.n_sub = n_bits // SUBSTRING
        self.radius = self.learn_radius(sample, neighbours) if len(sample) > neighbours else n_bits

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return (unit - self.mean) @ self.rotation > 0

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        return np.packbits(self.bits(unit), axis=1).view(np.uint16)

    def substrings(self, bits: np.ndarray, width: int) -> np.ndarray:
        """Codes as rows of substrings of that many bits; the last may be shorter."""
        return np.stack([bits[:, j : j + width] @ (1 << np.arange(min(width, bits.shape[1] - j))) for j in range(0, bits.shape[1], width)], axis=1)

    def learn_radius(self, sample: np.ndarray, neighbours: int) -> int:
        """The radius that holds that share of the true neighbours within the sample. In more rows neighbours are nearer."""
        q = min(SAMPLE_QUERIES, len(sample))
        score = sample[:q] @ sample.T
        score[np.arange(q), np.arange(q)] = -np.inf
        top = np.argpartition(-score, neighbours, axis=1)[:, :neighbours]
        code = self.of(sample)
        far = np.bitwise_count(code[:q, None, :] ^ code[top]).sum(2, dtype=np.int64)
        return int(np.quantile(far, SHARE, method="higher"))


def usable(column: str):
    """A vector of finite numbers, not all zero."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & good & F.exists(column, lambda x: x != 0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def substring_radii(radius: int, n_sub: int) -> list[int]:
    """Radii that add up to radius - n_sub + 1: a code beyond all of them lies beyond the radius."""
    spare = max(0, radius - n_sub + 1)
    return [spare // n_sub + (j < spare % n_sub) for j in range(n_sub)]


def probe(queries: np.ndarray, codes: np.ndarray, radius: int):
    """For each query's code the rows of all codes within the radius, through the indexes of the substrings."""
    radii = substring_radii(radius, codes.shape[1])
    index = [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])]
    whole = np.ascontiguousarray(codes).view(np.uint64) if codes.shape[1] % 4 == 0 else codes
    for query in queries:
        found = np.zeros(len(codes), bool)
        for j, (values, bucket) in enumerate(index):
            # the buckets within the substring's radius: of those that exist, which are fewer than all that could
            near = np.bitwise_count(values ^ query[j]) <= radii[j]
            if near.all():
                found[:] = True
                break
            found |= near[bucket]
        found = np.flatnonzero(found)
        own = np.ascontiguousarray(query).view(whole.dtype)
        yield found[np.bitwise_count(whole[found] ^ own).sum(1, dtype=np.int64) <= radius]


def search_block(model: Codes, k: int, radius: int):
    """Queries of one block against the index of one block; each query's k nearest of those found, by exact cosine."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids, x = left.column("vec_id").to_numpy(), unit(matrix(left.column("v")))
            single = len(np.unique(ids)) == len(ids)
            query_ids, q = right.column("vec_id").to_numpy(), unit(matrix(right.column("v")))
            for i, found in enumerate(probe(model.of(q), model.of(x), radius)):
                found = found[ids[found] != query_ids[i]]
                score = x[found] @ q[i]
                if len(found) > k and single:
                    least = np.partition(score, len(score) - k)[len(score) - k]
                    found = found[score >= least - 1e-9]
                score = (x[found] * q[i]).sum(1)  # equal vectors get equal scores wherever they stand
                order = np.lexsort((ids[found], -score))
                if not single:  # an id counts once, with its best
                    order = order[np.sort(np.unique(ids[found[order]], return_index=True)[1])]
                order = order[:k]
                out["query_id"].append(np.full(len(order), query_ids[i]))
                out["vec_id"].append(ids[found[order]])
                out["score"].append(score[order])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, float if c == "score" else np.int64) for c, v in out.items()})

    return run


def masks(width: int, radius: int) -> np.ndarray:
    """All numbers of that many bits of which at most radius are set."""
    return np.array([sum(1 << b for b in of) for n in range(min(radius, width) + 1) for of in itertools.combinations(range(width), n)], np.int64)


def coded(df: DataFrame, model: Codes, width: int, radius: int | None = None) -> DataFrame:
    """vec_id, code (64-bit words) and values: each substring's value, numbered in its high bits; with a radius also all
    values within that substring's part of it."""
    n_sub = -(-model.rotation.shape[1] // width)
    last = model.rotation.shape[1] - (n_sub - 1) * width
    reach = [masks(last if j == n_sub - 1 else width, r) for j, r in enumerate(substring_radii(radius, n_sub))] if radius is not None else [np.zeros(1, np.int64)] * n_sub

    def run(batches):
        for batch in (whole.slice(at, 512) for whole in batches for at in range(0, len(whole), 512)):  # a query may probe thousands of values
            bits = model.bits(unit(matrix(pa.chunked_array([batch.column("v")])))) if len(batch) else np.zeros((0, model.rotation.shape[1]), bool)
            values = model.substrings(bits, width) if len(batch) else np.zeros((0, n_sub), np.int64)
            probes = np.concatenate([(values[:, j, None] ^ reach[j]) | (j << 32) for j in range(n_sub)], axis=1)
            code = np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.int64)
            rows = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), rows(code), rows(probes)], names=["vec_id", "code", "values"])

    return df.select("vec_id", "v").mapInArrow(run, "vec_id long, code array<long>, values array<long>")


def by_index(vectors: DataFrame, asking: DataFrame, model: Codes, width: int, radius: int) -> DataFrame:
    """query_id, vec_id, score of all vectors within the radius of each query, by one join on substring and value."""
    n_words = -(-model.rotation.shape[1] // 64)
    index = coded(vectors, model, width).select("vec_id", "code", F.explode("values").alias("value"))
    probes = coded(asking, model, width, radius).select(F.col("vec_id").alias("query_id"), F.col("code").alias("q_code"), F.explode("values").alias("value"))
    apart = sum(F.bit_count(F.col("code")[i].bitwiseXOR(F.col("q_code")[i])) for i in range(n_words))
    met = index.join(probes, "value").filter((apart <= radius) & (F.col("vec_id") != F.col("query_id"))).select("query_id", "vec_id").distinct()
    full = met.join(asking.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(vectors, "vec_id")

    def run(batches):
        for batch in batches:
            if len(batch):
                x, q = (unit(matrix(pa.chunked_array([batch.column(c)]))) for c in ("v", "q"))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array((x * q).sum(1))], names=["query_id", "vec_id", "score"])

    return full.select("query_id", "vec_id", "v", "q").mapInArrow(run, "query_id long, vec_id long, score double")


def by_blocks(vectors: DataFrame, n_rows: int, asking: DataFrame, n_queries: int, model: Codes, k: int, radius: int) -> DataFrame:
    """The same by blocks of vectors that each block of queries meets once; of each block a query's k best."""
    n_blocks, n_visits = -(-n_rows // BLOCK_ROWS) or 1, -(-n_queries // BLOCK_QUERIES) or 1
    # repeated rows are spread by their place as well; equal answers fall together when the best are picked
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n_blocks))
    held = vectors.withColumn("block", block).withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(n_visits - 1))))
    asks = asking.withColumn("visit", F.pmod(F.xxhash64("vec_id"), F.lit(n_visits)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    return held.groupBy("block", "visit").cogroup(asks.groupBy("block", "visit")).applyInArrow(search_block(model, k, radius), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query among vectors (both hold vec_id and embedding).

    Nearness is the cosine in double precision; ties go to the smaller vec_id; a query's own id is no answer. Vectors
    that are null, empty or zero, or hold null or non-finite components, take no part, nor do null ids or vectors of
    another length than most. Repeated rows are one. Each query has k rows, or all its candidates where there are fewer;
    empty tables give an empty result.
    """
    tidy = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable("v"))
    vectors, queries = tidy(vectors), tidy(queries)
    lengths = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 1
    vectors = vectors.filter(F.size("v") == dim)
    queries = queries.filter(F.size("v") == dim)
    n_rows, n_queries = lengths["count"] if lengths else 0, queries.count()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    model = Codes(unit(matrix(sample.column("v"))) if len(sample) else np.zeros((0, dim)), k)
    # of equal vectors only those of the least ids can be among the nearest: a hot vector is k + 1 rows
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    vectors = cut(vectors.distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth"), "hamming-vectors")
    width = min(max(math.ceil(math.log2(max(2, n_rows))), WIDTHS[0]), WIDTHS[1])
    n_sub = -(-model.rotation.shape[1] // width)
    asking, radius, rounds = queries.distinct(), model.radius, []
    while True:
        probes = sum(math.comb(width, i) for r in substring_radii(radius, n_sub) for i in range(r + 1))
        if probes <= MOST_PROBES and probes * INDEX_SHARE <= n_rows:
            found = by_index(vectors, asking, model, width, radius)
        else:
            found = by_blocks(vectors, n_rows, asking, n_queries, model, k, radius)
        rounds.append(cut(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "hamming-found"))
        if radius >= model.n_sub * SUBSTRING:
            break
        served = rounds[-1].groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        asking = cut(asking.join(served, "vec_id", "left_anti"), "hamming-asking")
        n_queries = asking.count()
        if not n_queries:
            break
        radius = min(2 * radius + model.n_sub, model.n_sub * SUBSTRING)
    best = rounds[0]
    for more in rounds[1:]:  # what a narrow radius found, a wider one finds too
        best = best.unionByName(more)
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")) if len(rounds) > 1 else best
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
