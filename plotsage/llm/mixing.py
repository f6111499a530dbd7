"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / source_size times. The whole part of that is certain; the
fractional part is a probability. Pairs of documents transfer words between their probabilities at random, so that each
keeps its expectation and their words stay the same in sum, until one of the two is integral. A document too large for
one partner is paired with all the others of its node. Leaves of a tree round a bounded number of documents each and
hand on at most one that is still fractional; the next level pairs those.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotsage.llm.common import WORD, cut

#: Documents that one leaf of the reduction tree rounds, and residuals that one inner node does.
LEAF_ROWS = 4096
#: A document with more than one part in so many of a node's words is balanced by all its other documents.
LARGE = 64
#: Repeats of a row that are unrolled at a time.
RUN = 10_000
SEED = 20240
EPSILON = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, n_units, target of each source. Sources are ranked by code point, null last."""
    by_source = cut(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n_units")), "mix-sources")
    # a rank without one task that holds all sources: ranges first, then the number of rows before each range
    ranged = cut(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-ranges")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.coalesce("before", F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut(ranged.join(before, "part").withColumn("weight", weight).drop("part", "count", "before"), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = F.lit(0.0)
    capped = F.lit(False)
    while True:  # each round caps more sources than the one before, or is the last
        kept, free, n = ranked.agg(F.sum(F.when(capped, F.col("source_size") * cap)), F.sum(F.when(~capped, F.col("weight"))), F.count_if(capped)).first()
        if not free or not total:
            break
        level = F.lit((share * total - (kept or 0.0)) / free)
        capped_now = F.col("weight") * level > F.col("source_size") * cap
        if ranked.agg(F.count_if(capped_now)).first()[0] == n:
            break
        capped = capped_now
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * level) if total else F.lit(0.0)
    return cut(ranked.select("source", "source_size", "n_units", target.alias("target")), "mix-targets")


def closed(p: np.ndarray) -> np.ndarray:
    return np.where(p <= EPSILON, 0.0, np.where(p >= 1 - EPSILON, 1.0, p))


def pivot_large(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Settle documents (largest first) that hold more than 1 / LARGE of the words that are left.

    No single partner can balance such a document, so its partner is all the rest at once, each of which moves by the
    same probability. Each step makes the document or one of the rest integral."""
    p = closed(p)
    left = np.concatenate([np.cumsum(size[::-1])[::-1], [0.0]])
    for i in range(len(p)):
        if size[i] * LARGE <= left[i]:
            break
        while 0 < p[i] < 1:
            rest = np.flatnonzero((p[i + 1 :] > 0) & (p[i + 1 :] < 1)) + i + 1
            if not len(rest):
                break
            words = size[rest].sum()
            up, down = min(size[i] * (1 - p[i]), p[rest].min() * words), min(size[i] * p[i], (1 - p[rest].max()) * words)
            move = up if draw.random() * (up + down) < down else -down
            p[i] += move / size[i]
            p[rest] -= move / words
            p = closed(p)
    return p


def pivot(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the probabilities p by pairs, in order; the index of the one that stays fractional (-1: none)."""
    p = closed(p)
    held = -1
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if held < 0:
            held = int(i)
            continue
        a, b = p[held] * size[held], p[i] * size[i]  # in words; a + b stays
        up, down = min(size[held] - a, b), min(a, size[i] - b)
        move = up if draw.random() * (up + down) < down else -down
        p[[held, i]] = closed(np.array([(a + move) / size[held], (b - move) / size[i]]))
        held = next((int(j) for j in (held, i) if 0 < p[j] < 1), -1)
    return p, held


def round_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Round the rows of one node of the tree. The order and the draws hang on the rows alone, so reruns agree.

    Large documents come first: what stays open at the end is then a small one as a rule, and the sum of words near."""
    rows = rows.sort_values(["words", "draw", "doc_id"], ascending=[False, True, True], kind="stable")
    draw = np.random.default_rng(int(rows["draw"].iloc[0] * (1 << 40)))
    size = rows["words"].to_numpy()
    p, held = pivot(pivot_large(rows["p"].to_numpy(), size, draw), size, draw)
    rows["p"] = p
    rows["open"] = np.arange(len(rows)) == held
    rows["draw"] = (rows["draw"] * 1_000_003.7 + 0.137) % 1.0
    return rows


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted) and copies, a row for each row of docs.

    Null or empty texts have size 0 and are taken 0 times. A null source is a source, the last. Repeated rows are taken
    as one unit and share its copies out evenly, so that no row exceeds cap times its size. Null doc_ids are kept.
    An empty table gives an empty result. Columns of docs other than doc_id, text and source are left out. A source's
    words miss its target by less than its largest document.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # equal rows become one unit: a row that is repeated very often is neither a hot key nor a matter of row order
    units = cut(docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "mix-sizes")
    targets = source_targets(units, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("times")
    draw = F.pmod(F.xxhash64("doc_id", "source", "size", F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)
    leaf = F.pmod(F.xxhash64("doc_id", "size", F.lit(SEED + 1)), F.greatest(F.lit(1), F.ceil(F.col("n_units") / leaf_rows)))
    joined = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    columns = ["doc_id", "source", "size", "times", "source_size", "target"]
    node = joined.select(*columns, F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), (F.col("size") * 1.0).alias("words"), draw.alias("draw"), leaf.alias("node"))
    schema = node.withColumn("open", F.lit(True)).schema
    unsized = node.filter("size = 0").withColumn("p", F.lit(0.0))
    done = [unsized.withColumn("whole", F.lit(0).cast("long"))]
    widest = targets.agg(F.max(F.ceil(F.col("n_units") / leaf_rows))).first()[0] or 1
    level = cut(node.filter("size > 0").groupBy("source", "node").applyInPandas(round_group, schema), "mix-level")
    while True:
        done.append(level.filter("not open").drop("open"))
        rest = level.filter("open").drop("open").withColumn("node", F.floor(F.col("node") / leaf_rows))
        if widest <= 1:
            break
        widest = -(-widest // leaf_rows)
        level = cut(rest.groupBy("source", "node").applyInPandas(round_group, schema), "mix-level")
    done.append(rest.withColumn("p", F.when(F.col("draw") < F.col("p"), 1.0).otherwise(0.0)))
    rounded = done[0]
    for part in done[1:]:
        rounded = rounded.unionByName(part)
    copies = (F.col("whole") + F.round("p").cast("long")).alias("unit_copies")
    # in runs of bounded length: a row may be repeated any number of times
    runs = rounded.select(*columns, copies, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {RUN}"))).alias("run"))
    each = runs.select(*columns, "unit_copies", F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("times"), (F.col("run") + 1) * RUN))).alias("nth"))
    own = (F.floor(F.col("unit_copies") / F.col("times")) + F.when(F.col("nth") <= F.col("unit_copies") % F.col("times"), 1).otherwise(0)).alias("copies")
    return each.select("doc_id", "source", "size", "source_size", "target", own).withColumn("taken", F.col("size") * F.col("copies"))
