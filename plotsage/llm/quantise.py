"""Vector codes by product quantisation in whole numbers, nearest entries found by a GNAT.

Vectors are cut into equal parts; each part position has a codebook that rounds of means refine. A GNAT (geometric
near-neighbour access tree) over a codebook's entries takes a few of them as split points, gives the others to the nearest
split point, and keeps for each split point the range of its distances to each subtree. A part's distance to a split point
then rules out whole subtrees: those whose range lies, by the triangle inequality, strictly farther than the best entry so
far. Square roots are rounded so that no subtree is ruled out wrongly, and squared distances decide in whole numbers, so
that ties go to the lower index.

Spark assigns the parts of all vectors in each round and adds up what falls to each entry, task by task and then over
tasks; only the codebooks, of a fixed size, pass through the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import cut, id_column

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Split points of a node; nodes of no more entries than that are leaves.
DEGREE = 4
#: Vectors that are looked at side by side.
CHUNK = 4096
#: Roots of whole numbers below 2**63 err by less than this share.
SLACK = 2.0**-50
FAR = np.iinfo(np.int64).max


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one entry, exact."""
    apart = x - entry
    return (apart * apart).sum(-1)


def lower_root(d) -> np.ndarray:
    return np.sqrt(np.asarray(d, np.float64)) * (1 - SLACK)


def upper_root(d) -> np.ndarray:
    return np.sqrt(np.asarray(d, np.float64)) * (1 + SLACK)


class Gnat:
    """entries: rows of whole numbers; of: the indexes of those in this node."""

    def __init__(self, entries: np.ndarray, of: np.ndarray | None = None, degree: int = DEGREE):
        of = np.arange(len(entries)) if of is None else of
        self.entries = entries
        self.leaf = len(of) <= degree
        if self.leaf:
            self.splits, self.children = of, []
            return
        splits = [int(of[0])]
        near = squared(entries[of], entries[splits[0]])
        while len(splits) < degree:  # the farthest from all split points so far
            splits.append(int(of[np.argmax(np.where(np.isin(of, splits), -1, near))]))
            near = np.minimum(near, squared(entries[of], entries[splits[-1]]))
        self.splits = np.array(splits)
        rest = of[~np.isin(of, self.splits)]
        owner = np.argmin(np.stack([squared(entries[rest], entries[p]) for p in splits]), axis=0)
        groups = [rest[owner == j] for j in range(degree)]
        self.children = [Gnat(entries, g, degree) if len(g) else None for g in groups]
        # from each split point to each subtree with that one's split point: least and greatest distance, rounded outwards
        self.low, self.high = np.zeros((degree, degree)), np.zeros((degree, degree))
        for i, p in enumerate(splits):
            for j, g in enumerate(groups):
                d = squared(entries[g if i == j else np.append(g, splits[j])], entries[p])
                self.low[i, j], self.high[i, j] = (lower_root(d.min()), upper_root(d.max())) if len(d) else (np.inf, -np.inf)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of the nearest entry and the squared distance to it."""
        index, best = np.full(len(x), FAR), np.full(len(x), FAR)
        self._search(x, np.arange(len(x)), index, best)
        return index, best

    def _search(self, x: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        alive = np.ones((len(rows), len(self.splits)), bool)
        seen = []
        for i, p in enumerate(self.splits):
            asked = np.flatnonzero(alive[:, i])
            at = rows[asked]
            d = squared(x[at], self.entries[p])
            better = (d < best[at]) | ((d == best[at]) & (p < index[at]))
            best[at[better]], index[at[better]] = d[better], p
            seen.append((asked, d))
            if not self.leaf:
                self._rule_out(alive, asked, d, i, best[at])
        if self.leaf:
            return
        for i, (asked, d) in enumerate(seen):  # once more, by the best of all split points
            self._rule_out(alive, asked, d, i, best[rows[asked]])
        for j, child in enumerate(self.children):
            if child and len(left := rows[alive[:, j]]):
                child._search(x, left, index, best)

    def _rule_out(self, alive: np.ndarray, asked: np.ndarray, d: np.ndarray, i: int, best: np.ndarray) -> None:
        """Subtrees all of whose entries are strictly farther than the best so far."""
        reach = upper_root(best)
        beyond = (lower_root(d)[:, None] - self.high[i] > reach[:, None]) | (self.low[i] - upper_root(d)[:, None] > reach[:, None])
        alive[asked] &= ~beyond


def whole(column: str, most: int):
    """Components as whole numbers, at most so far from 0."""
    scaled = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(most))), F.lit(float(-most))))
    return F.transform(column, lambda x: scaled(x).cast("long"))


def usable(column: str):
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & good


def limit(width: int) -> int:
    """The greatest component for which distances of parts of that width, and their sums over all parts, fit 64 bits."""
    return math.isqrt((1 << 56) // max(1, width))


def vectors_of(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label and c (whole numbers) of the vectors that take part, and their length."""
    kind = id_column(vectors.select(F.col("vec_id").alias("doc_id")))[1]
    read = vectors.select(F.col("vec_id").cast(kind).alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v")).filter(usable("v"))
    lengths = read.groupBy(F.size("v").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else parts
    return read.filter(F.size("v") == dim).select("vec_id", "label", whole("v", limit(dim // parts)).alias("c")), dim


def split(column: pa.Array, dim: int, parts: int) -> np.ndarray:
    """rows x parts x width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, dim // parts)


def sums(vectors: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """part, entry, at, n and total: over all vectors whose part is nearest to that entry, how many, and the sum of each
    component."""
    parts = len(books)

    def run(batches):
        trees = [Gnat(b) for b in books]
        n = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((parts, len(books[0]), dim // parts), np.int64)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                x = split(batch.column("c").slice(at, CHUNK), dim, parts)
                for j, tree in enumerate(trees):
                    index, _ = tree.nearest(x[:, j])
                    n[j] += np.bincount(index, minlength=len(books[j]))
                    np.add.at(total[j], index, x[:, j])
        j, e = np.nonzero(n)
        width = dim // parts
        repeat = lambda v: pa.array(np.repeat(v, width))
        yield pa.RecordBatch.from_arrays([repeat(j.astype(np.int32)), repeat(e.astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(j))), repeat(n[j, e]), pa.array(total[j, e].ravel())], names=["part", "entry", "at", "n", "total"])

    found = vectors.select("c").mapInArrow(run, "part int, entry int, at int, n long, total long")
    # as decimals: sums over very many rows may leave 64 bits
    return found.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def trained(vectors: DataFrame, dim: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks: as many as parts, each a row for each entry. Only they and their sums come to the driver."""
    start = vectors.orderBy(F.asc_nulls_last("vec_id"), "c").select("c").limit(entries).toArrow()
    first = split(start.column("c").combine_chunks(), dim, parts) if len(start) else np.zeros((0, parts, dim // parts), np.int64)
    books = [np.ascontiguousarray(first[:, j]) for j in range(parts)]
    for _ in range(rounds if len(first) else 0):
        for row in sums(vectors, books, dim).collect():
            books[row["part"]][row["entry"], row["at"]] = int(row["total"]) // row["n"]
    return books


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(x)) for b in books for x in b.ravel())


def encoded(vectors: DataFrame, books: list[np.ndarray], dim: int) -> DataFrame:
    """vec_id, label, code and error of each vector."""
    kind, label = dict(vectors.dtypes)["vec_id"], dict(vectors.dtypes)["label"]
    digits = np.array([f"{i:02x}" for i in range(max(1, len(books[0])))])

    def run(batches):
        trees = [Gnat(b) for b in books]
        for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, len(b), CHUNK)):
            x = split(batch.column("c"), dim, len(books))
            found = [tree.nearest(x[:, j]) for j, tree in enumerate(trees)]
            code = ["".join(row) for row in digits[np.stack([index for index, _ in found], axis=1)]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id {kind}, label {label}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code and error of each row of vectors (vec_id, label, embedding) that takes part, and the codebooks.

    Components become floor(4096 * x). Codebooks start as the parts of the least vec_ids (nulls last, of equal ids the
    smaller vector first); rounds assign all parts to the nearest entries, ties to the lower index, and replace entries by
    the means of their parts, rounded down; unused entries stay. Fewer vectors than entries make smaller codebooks. Vectors
    that are null or hold null or non-finite components take no part, nor do those whose length is no multiple of parts or
    another than most have. Components so large that distances would leave 64 bits (beyond 23,000 in parts of 8) count as
    the largest that do not. Repeated rows are coded each; other columns are left out; an empty table gives an empty result.
    """
    kept, dim = vectors_of(vectors, parts)
    kept = cut(kept, "quantise-vectors")
    books = trained(kept, dim, parts, entries, rounds)
    return encoded(kept, books, dim), books


def digest(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """coded with the errors summed over equal labels, nulls together, and the hash of all codebooks."""
    done = cut(coded, "quantise-codes")
    by_label = done.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    full = done.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    most = F.least(F.col("label_error"), F.lit(FAR).cast("decimal(38,0)")).cast("long")
    return full.select("vec_id", "code", "error", most.alias("label_error"), F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"), "label")


def digest_sql(dim: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB's SQL, for vectors of that length: every part against every entry, round by round."""
    width = dim // parts
    apart = " + ".join(f"(x[{i}] - y[{i}]) * (x[{i}] - y[{i}])" for i in range(1, width + 1))
    mean = "[" + ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*) + count(*)) % count(*))) // count(*)" for i in range(1, width + 1)) + "]"
    steps = []
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, p.part, min(({apart}) * {entries} + entry) AS packed FROM p JOIN b{n} b ON p.part = b.part GROUP BY r, p.part)")
        if n < rounds:
            steps.append(f"m{n} AS MATERIALIZED (SELECT part, packed % {entries} AS entry, list_transform({mean}, lambda v: CAST(v AS BIGINT)) AS y FROM a{n} JOIN p USING (r, part) GROUP BY part, packed % {entries})")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.y, b.y) AS y FROM b{n} b LEFT JOIN m{n} m USING (part, entry))")
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, j AS part, c[j * {width} + 1 : j * {width} + {width}] AS x FROM k, range({parts}) t(j)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS y FROM p WHERE r <= {entries}),
{", ".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', packed % {entries}), '' ORDER BY part) AS code, CAST(sum(packed // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256, label
FROM f JOIN k USING (r)"""
