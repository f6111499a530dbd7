"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive tokens, of which it ignores some: a substituted token falls into the gaps of
one seed or the other. Seeds of benchmark items and of documents meet by hash. A filter of bounded size, made from the
benchmark's hashes, spares the documents' other hashes the shuffle; it lets no hit through its fingers. Around hits,
tokens are compared along the diagonal, so that overlaps with substitutions are measured as they are.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import byte_table, cut, is_word_byte, lists, mix64, numbers, pieces, words

#: Fixed masks of six tokens each, for windows in which they miss no pattern of substitutions; others have their own.
MASKS = ("11101011", "110110101", "1101001011", "11001010011")
WEIGHT = 6
WINDOW, SIMILARITY = 13, 0.8
#: Bits of the filter for each of the benchmark's hashes, and its largest size in bits.
FILTER_BITS, FILTER_MOST = 32, 1 << 27


def covered(masks: tuple[str, ...], width: int, substitutions: int) -> bool:
    """Whether, wherever so many tokens of a window are substituted, one mask fits in somewhere and ignores all of them."""
    kept = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(width - len(m) + 1)]
    return all(any(k.isdisjoint(gone) for k in kept) for gone in itertools.combinations(range(width), substitutions))


@functools.cache
def masks_for(width: int, similarity: float) -> tuple[str, ...]:
    """Masks that find every window of so many tokens of which a share of similarity are the same.

    Where the fixed masks miss some, masks over the whole window are chosen one by one: each ignores as many tokens as leave
    it WEIGHT (or as may be substituted), and among those the most sets of substitutions that no other mask ignores."""
    substitutions = math.floor((1 - similarity) * width + 1e-9)
    if covered(MASKS, width, substitutions):
        return MASKS
    left = set(itertools.combinations(range(width), substitutions))
    holes = list(itertools.combinations(range(width), max(substitutions, width - WEIGHT))) if substitutions else [()]
    chosen = []
    while left:
        best = max(holes, key=lambda h: sum(set(gone) <= set(h) for gone in left))
        left = {gone for gone in left if not set(gone) <= set(best)}
        chosen.append("".join("0" if i in best else "1" for i in range(width)))
    return tuple(chosen)


def seeds(tokens: np.ndarray, firsts: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the mask at each token where it fits into its text, and those tokens' indexes."""
    span = len(mask)
    at = np.arange(len(tokens) - span + 1)
    if len(at) <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begins = np.zeros(len(tokens) + 1, np.int32)
    np.add.at(begins, firsts[1:-1], 1)
    text_of = np.cumsum(begins)
    at = at[text_of[at] == text_of[at + span - 1]]
    factors = numbers(sum(1 << i for i, c in enumerate(mask) if c == "1") + (span << 20), span) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += tokens[at + k] * factors[k]
    return mix64(out), at


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(bits - 1)
    return hashes & top, (hashes >> np.uint64(32)) & top


def tokens_of(items: DataFrame, key: str) -> DataFrame:
    """key and tokens (hashes) of each text."""
    table, inside = byte_table(lower=True), is_word_byte()

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(1)):
                hashes, _, _, firsts = words(data, offsets, table, inside)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists(hashes.view(np.int64), firsts)], names=[key, "tokens"])

    return items.mapInArrow(run, f"{key} {dict(items.dtypes)[key]}, tokens array<long>")


def item_seeds(items: DataFrame, similarity: float) -> DataFrame:
    """item, mask, hash and place of each seed of the items' tokens."""

    def run(batches):
        for batch in batches:
            lengths = batch.column("tokens").value_lengths().to_numpy()
            tokens, firsts = batch.column("tokens").flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lengths)])
            widths = np.minimum(lengths, WINDOW)
            wanted: dict[str, list[int]] = {}
            for width in np.unique(widths[widths > 0]).tolist():
                for mask in masks_for(width, similarity):
                    wanted.setdefault(mask, []).append(width)
            for mask, of in wanted.items():
                hashes, at = seeds(tokens, firsts, mask)
                text = np.searchsorted(firsts, at, side="right") - 1
                own = np.isin(widths[text], of)
                hashes, at, text = hashes[own], at[own], text[own]
                items_ = batch.column("item").take(pa.array(text))
                yield pa.RecordBatch.from_arrays([items_, pa.array([mask] * len(at), pa.string()), pa.array(hashes.view(np.int64)), pa.array((at - firsts[text]).astype(np.int32))], names=["item", "mask", "hash", "place"])

    return items.mapInArrow(run, f"item {dict(items.dtypes)['item']}, mask string, hash long, place int")


def hash_filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of two positions for each hash, of bounded size; made by Spark, bit by bit."""
    n = hashes.count()
    bits = min(FILTER_MOST, max(1 << 16, 1 << math.ceil(math.log2(max(1, n) * FILTER_BITS))))
    low, high = F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1)
    each = hashes.select(F.explode(F.array(low, high)).alias("slot"))
    words_ = each.groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot & 7 as int))")).alias("bits"))
    got = words_.toArrow()  # at most FILTER_MOST / 8 rows
    filled = np.zeros(bits // 8, np.uint8)
    filled[got.column("byte").to_numpy()] = got.column("bits").to_numpy()
    return filled, bits


def segments(docs: DataFrame, masks: list[str], shared, bits: int) -> DataFrame:
    """Stretches of tokens around seeds that pass the filter: key, at (of the first token), tokens, starts and ends of
    tokens in code points, and the hits in it (hashes and places)."""
    table, inside = byte_table(lower=True), is_word_byte()

    def run(batches):
        filled = shared.value
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(1)):
                tokens, start, end, firsts = words(data, offsets, table, inside)
                found, places, spans = [], [], []
                for mask in masks:
                    hashes, where = seeds(tokens, firsts, mask)
                    a, b = slots(hashes, bits)
                    keep = np.flatnonzero((filled[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1)
                    b = b[keep]
                    keep = keep[((filled[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1) == 1]
                    found.append(hashes[keep])
                    places.append(where[keep])
                    spans.append(np.full(len(keep), len(mask)))
                hashes, where, span = np.concatenate(found), np.concatenate(places), np.concatenate(spans)
                order = np.argsort(where, kind="stable")
                hashes, where, span = hashes[order], where[order], span[order]
                if not len(where):
                    continue
                text = np.searchsorted(firsts, where, side="right") - 1
                low, high = np.maximum(where - WINDOW, firsts[text]), np.minimum(where + span + WINDOW, firsts[text + 1])
                reach = np.maximum.accumulate(high)
                new = np.concatenate([[True], (low[1:] >= reach[:-1]) | (text[1:] != text[:-1])])
                first_hit = np.flatnonzero(new)
                seg_low, seg_high = low[first_hit], np.maximum.reduceat(high, first_hit)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[offsets[text[first_hit]]]
                take = np.concatenate([np.arange(lo, hi) for lo, hi in zip(seg_low, seg_high, strict=True)])
                begin = np.concatenate([[0], np.cumsum(seg_high - seg_low)])
                shift = np.repeat(base, seg_high - seg_low)
                hit_begin = np.append(first_hit, len(where))
                hit_place = (where - np.repeat(seg_low, np.diff(hit_begin))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at + text[first_hit])), pa.array((seg_low - firsts[text[first_hit]]).astype(np.int32)), lists(tokens[take].view(np.int64), begin),
                        lists((points[start[take]] - shift).astype(np.int32), begin), lists((points[end[take]] - shift).astype(np.int32), begin), lists(hashes.view(np.int64), hit_begin), lists(hit_place, hit_begin),
                    ],
                    names=["key", "at", "tokens", "starts", "ends", "hashes", "places"],
                )

    return docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, at int, tokens array<long>, starts array<int>, ends array<int>, hashes array<long>, places array<int>")


def overlap(tokens: np.ndarray, item: np.ndarray, diagonal: int, similarity: float) -> tuple[int, int, int] | None:
    """First and last token (end exclusive) and matches of the overlap of tokens[i + diagonal] with item[i], if one is."""
    lo, hi = max(0, -diagonal), min(len(item), len(tokens) - diagonal)
    width = min(WINDOW, len(item))
    if hi - lo < width:
        return None
    same = tokens[lo + diagonal : hi + diagonal] == item[lo:hi]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= similarity * width - 1e-9)
    if not len(good):
        return None
    covered = np.zeros(len(same) + 1, np.int32)
    np.add.at(covered, good, 1)
    np.add.at(covered, good + width, -1)
    inside = np.flatnonzero((np.cumsum(covered[:-1]) > 0) & same)
    return int(inside[0]) + lo + diagonal, int(inside[-1]) + 1 + lo + diagonal, len(inside)


def verify(similarity: float, item_type: str, key_type: str):
    def run(batches):
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            values = {c: (cols[c].flatten().to_numpy(), np.concatenate([[0], np.cumsum(cols[c].value_lengths().to_numpy())])) for c in ("tokens", "starts", "ends", "item_tokens")}
            part = lambda c, i: values[c][0][values[c][1][i] : values[c][1][i + 1]]  # noqa: E731, B023
            rows, out = [], []
            for i, diagonal in enumerate(cols["diagonal"].to_numpy()):
                if found := overlap(part("tokens", i), part("item_tokens", i), int(diagonal), similarity):
                    a, b, n = found
                    rows.append(i)
                    out.append((int(part("starts", i)[a]), int(part("ends", i)[b - 1]), b - a, n))
            take = pa.array(rows, pa.int64())
            numbers_ = [pa.array([x[k] for x in out], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([cols["key"].take(take), cols["item"].take(take), *numbers_], names=["key", "item", "start", "end", "tokens", "matches"])

    return run, f"key {key_type}, item {item_type}, start int, end int, tokens int, matches int"


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """key, item, start, end (code points of the text), tokens and matches of each overlap of a text with an item.

    Tokens are runs of letters and digits, lower case by ASCII. An overlap is where, in some window of 13 tokens (or the
    whole of a shorter item), a share of at least similarity are the same at the same places; it covers all such windows
    of one diagonal. No such overlap is missed, whatever is substituted where. Null and empty texts and items have none; a null key is a key, and a null item an item; rows of equal
    keys are told together, and texts of equal items too; other columns are left out; an empty table on either side gives
    an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item].alias("item"), F.coalesce(benchmark["text"], F.lit("")).alias("text")).distinct()
    items = cut(tokens_of(items, "item").filter("size(tokens) > 0").withColumn("nth", F.monotonically_increasing_id()), "decon-items")
    seeded = cut(item_seeds(items.select(F.col("nth").alias("item"), "tokens"), similarity).withColumnRenamed("item", "nth"), "decon-seeds")
    filled, bits = hash_filter(seeded)
    masks = [r[0] for r in seeded.select("mask").distinct().orderBy("mask").collect()]  # as many as windows of up to 13 tokens need
    shared = spark.sparkContext.broadcast(filled)  # of bounded size
    own = docs.select(docs[key].alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    found = segments(own, masks, shared, bits) if masks else segments(own.limit(0), [MASKS[0]], shared, bits)
    found = cut(found.withColumn("segment", F.monotonically_increasing_id()), "decon-segments")
    hits = found.select("segment", F.explode(F.arrays_zip("hashes", "places")).alias("hit")).select("segment", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("at_place"))
    lined = hits.join(seeded.select("nth", "hash", "place"), "hash").groupBy("segment", "nth", (F.col("at_place") - F.col("place")).alias("diagonal")).agg(F.min("at_place").alias("low"), F.max("at_place").alias("high"))
    full = lined.join(found.select("segment", "key", "tokens", "starts", "ends"), "segment").join(items.withColumnRenamed("tokens", "item_tokens"), "nth")
    # only what lies along the item and near its hits: a window that counts holds one of them
    begin = F.greatest(F.lit(0), "diagonal", F.col("low") - WINDOW).cast("int")
    end = F.least(F.size("tokens"), F.col("diagonal") + F.size("item_tokens"), F.col("high") + 2 * WINDOW).cast("int")
    full = full.withColumn("begin", begin).withColumn("n", F.greatest(F.lit(0), end - F.col("begin")))
    full = full.withColumns({c: F.slice(c, F.col("begin") + 1, F.col("n")) for c in ("tokens", "starts", "ends")}).withColumn("diagonal", F.col("diagonal") - F.col("begin"))
    run, schema = verify(similarity, dict(items.dtypes)["item"], dict(own.dtypes)["key"])
    return full.select("key", "item", "tokens", "starts", "ends", "item_tokens", "diagonal").mapInArrow(run, schema).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_spans, matches (most of one span) and spans (start:end, comma-joined) of each leaked item of a document."""
    found = overlaps(docs, benchmark, **options)
    span = F.struct("start", "end")
    told = found.groupBy("key", "item").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.max("matches").cast("long").alias("matches"))
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return told.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), F.size("spans").cast("long").alias("n_spans"), "matches", text.alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text has no overlap with the benchmark; all columns stay, whatever their names."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    kept = cut(docs.toDF(*columns).withColumn("row", F.monotonically_increasing_id()), "decon-docs")
    texts = kept.select("row", F.col(columns[docs.columns.index("text")]).alias("text"))
    bad = overlaps(texts, benchmark, key="row", **options).select(F.col("key").alias("row")).distinct()
    return kept.join(bad, "row", "left_anti").select(*columns).toDF(*docs.columns)
