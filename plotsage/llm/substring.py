"""Substring dedup by content-defined chunks.

A gear hash rolls over the characters of a text: each step shifts the hash and adds the character's number, so that it
depends on the last 32 characters only. Where its top bits are zero a chunk ends. Equal passages therefore have equal
chunks however the text around them was shifted. Digests of two neighbouring chunks are deduplicated over the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.columns import let
from plotsage.llm.common import cut, id_column, is_blank, mix64, numbers, pieces, powers

#: Top bits that must be zero (one place in 16), least and most characters of a chunk.
BITS, LEAST, MOST = 4, 12, 128
#: Words that a stretch of repeated chunks must hold to be told, or characters, as some scripts have no blanks.
MIN_WORDS, MIN_CHARS = 16, 400


def boundaries(points: np.ndarray, begins: np.ndarray, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all texts (begins: where each text begins, len + 1), and each text's number of chunks."""
    n = len(begins) - 1
    # a text's first characters must not see the text before it: each text is moved 32 empty steps away
    room = 32
    spread = np.zeros(len(points) + room * n, np.uint32)
    at = np.arange(len(points)) + room * (np.repeat(np.arange(n), np.diff(begins)) + 1)
    number = (mix64(points.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
    spread[at] = number
    for k in (1, 2, 4, 8, 16):  # doubling the reach five times equals rolling 32 steps
        more = spread << np.uint32(k)
        spread[k:] += more[:-k]
    candidate = np.flatnonzero(spread[at] >> np.uint32(32 - bits) == 0) + 1
    ends, per_text = [], np.zeros(n, np.int64)
    bounds = np.searchsorted(candidate, begins)
    for i in range(n):
        lo, hi = int(begins[i]), int(begins[i + 1])
        if lo == hi:
            continue
        had = len(ends)
        last = lo
        for c in candidate[bounds[i] : bounds[i + 1]].tolist():
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
        while hi - last > most:
            last += most
            ends.append(last)
        if hi > last:
            ends.append(hi)
        per_text[i] = len(ends) - had
    return np.array(ends, np.int64), per_text


def digests(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of points[begin:end], whatever stands before."""
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(points.astype(np.uint64) + numbers(31, 1)[0]) * powers(base, len(points)), dtype=np.uint64)])
    return mix64((sums[end] - sums[begin]) * powers(inverse, len(points) + 1)[begin] + (end - begin).astype(np.uint64))


def chunked(docs: DataFrame, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """row, doc_id, at and digest of each two neighbouring chunks of each text; a text of one chunk has that chunk.

    at packs where they stand into one number, as most of what is shuffled is these rows: start (code points) times 2**32,
    then eight bits each for the characters and the words of the first chunk and those of the second (7 bits), and a last
    bit that says whether the same digest occurs before in the same text.
    """

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column("text")):
                lead = (data & 0xC0) != 0x80
                begins = np.concatenate([[0], np.cumsum(lead)])[offsets]
                points = data.astype(np.uint32) if lead.all() else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
                ends, per_text = boundaries(points, begins, bits, least, most)
                if not len(ends):
                    continue
                text = np.repeat(np.arange(to - at), per_text)
                first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
                start = np.where(np.arange(len(ends)) == first[text], begins[text], np.concatenate([[0], ends[:-1]]))
                paired = np.append(text[1:] == text[:-1], False)
                stop = np.where(paired, np.append(ends[1:], 0), ends)
                rows = np.flatnonzero(paired | (per_text[text] == 1))
                text, start, middle, stop = text[rows], start[rows], ends[rows], stop[rows]
                inside = ~is_blank(points)
                word = np.concatenate([[0], np.cumsum(inside & ~np.concatenate([[False], inside[:-1]]))])
                digest_ = digests(points, start, stop)
                again = np.ones(len(text), np.int64)
                again[_firsts(text, digest_)] = 0
                packed = ((start - begins[text]) << 32) | ((middle - start) << 24) | ((word[middle] - word[start]) << 16) | ((stop - middle) << 8) | ((word[stop] - word[middle]) << 1) | again
                take = pa.array(at + text)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(take), batch.column("doc_id").take(take), pa.array(packed), pa.array(digest_.view(np.int64))], names=["row", "doc_id", "at", "digest"])

    return docs.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {id_column(docs)[1]}, at long, digest long")


def _firsts(text: np.ndarray, digest_: np.ndarray) -> np.ndarray:
    """Indexes of the first of each text and digest."""
    order = np.lexsort((np.arange(len(text)), digest_, text))
    new = np.concatenate([[True], (text[order][1:] != text[order][:-1]) | (digest_[order][1:] != digest_[order][:-1])])
    return order[new]


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, bits: int = BITS, least: int = LEAST, most: int = MOST) -> DataFrame:
    """row (a number), doc_id and spans of each row of docs that holds a repeated passage.

    spans: start and end (code points, end exclusive), words, and copy: whether each of its chunk pairs occurs before, in
    the table as it was read or earlier in the text, so that dropping all copies keeps one of each. A passage is a
    stretch of chunks whose every neighbouring pair occurs elsewhere too, in the same or another text, and that holds at
    least min_words words or 400 characters; where it holds that much of copies beside other pairs, it is told in parts. The
    pairs of a stretch may recur in different texts. Pairs are told by 64-bit digests: two that differ may share one in very
    large tables, but a stretch needs several in a row. Null and empty texts have none; null doc_ids are kept; repeated rows are repeats of each
    other; other columns are left out; an empty table gives an empty result.
    """
    keyed = docs.select(id_column(docs)[0].alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    pairs = cut(chunked(keyed, bits, least, most), "substring-pairs")
    many = pairs.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    hits = pairs.select("digest", "row", "at").join(cut(many, "substring-many"), "digest")
    gathered = hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", (F.col("row") != F.col("first")).alias("later")))).alias("packed"))

    def opened(x):
        bits_ = lambda shift, width: F.shiftright(x["at"], shift).bitwiseAND((1 << width) - 1).cast("int")
        start = F.shiftright(x["at"], 32).cast("int")
        middle = start + bits_(24, 8)
        return F.struct(start.alias("start"), middle.alias("middle"), (middle + bits_(8, 8)).alias("end"), bits_(16, 8).alias("words"), bits_(1, 7).alias("more_words"), (x["later"] | (bits_(0, 1) == 1)).alias("copy"))

    told = gathered.select("row", F.transform("packed", opened).alias("hits")).select("row", stretches(F.col("hits"), min_words).alias("spans")).filter(F.size("spans") > 0)
    # each text has one pair at its very beginning, which tells its id
    ids = pairs.filter(F.shiftright("at", 32) == 0).select("row", "doc_id")
    return told.join(ids, "row").select("row", "doc_id", "spans")


def runs(items, new):
    """Items cut into arrays before each place (from 1) at which new is true."""
    begins = F.filter(F.sequence(F.lit(1), F.size(items)), lambda i: (i == 1) | new(i))
    after = lambda b, i: F.coalesce(F.get(b, i + 1), F.size(items) + 1)
    return let(begins, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda i: F.slice(items, b[i], after(b, i) - b[i])))


def stretches(hits, min_words: int):
    """Hits of one text, in order, joined where they overlap; short stretches are left out. What holds min_words words or
    400 characters of copies within a stretch is told apart from the rest of it. Takes time in proportion to the hits."""
    before = lambda i: F.greatest(i - 2, F.lit(0))
    # pairs of chunks share a chunk with the next: the second one's words count with the last pair only
    words = lambda run: F.aggregate(run, F.lit(0), lambda acc, h: acc + h["words"]) + F.element_at(run, -1)["more_words"]
    enough = lambda run: (words(run) >= min_words) | (F.element_at(run, -1)["end"] - run[0]["start"] >= MIN_CHARS)

    def marked(run):
        alike = runs(run, lambda i: run[i - 1]["copy"] != run[before(i)]["copy"])
        return F.flatten(F.transform(alike, lambda r: let(r[0]["copy"] & enough(r), lambda copy: F.transform(r, lambda h: h.withField("copy", copy)))))

    def told(parts):
        def one(part, i):
            first, last, copy = part[0], F.element_at(part, -1), part[0]["copy"]
            # the chunk that a rest shares with copies beside it is theirs
            left, right = ~copy & (i > 0), ~copy & (i < F.size(parts) - 1)
            start, end = F.when(left, first["middle"]).otherwise(first["start"]), F.when(right, last["middle"]).otherwise(last["end"])
            shared = F.when(left, first["words"]).otherwise(0) + F.when(right, last["more_words"]).otherwise(0)
            return F.struct(start.alias("start"), end.alias("end"), (words(part) - shared).alias("words"), copy.alias("copy"))

        return F.filter(F.transform(parts, one), lambda s: s["end"] > s["start"])

    def split(run):
        return let(marked(run), lambda m: let(runs(m, lambda i: m[i - 1]["copy"] != m[before(i)]["copy"]), told))

    joined = let(hits, lambda h: runs(h, lambda i: h[i - 1]["start"] > h[before(i)]["middle"]))
    return F.flatten(F.transform(F.filter(joined, enough), split))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_repeats, n_copies (of which an earlier one is kept), repeated_words and spans (start:end, comma-joined)."""
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    copies = F.size(F.filter("spans", lambda x: x["copy"])).cast("long")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_repeats"), copies.alias("n_copies"), F.aggregate("spans", F.lit(0), lambda a, x: a + x["words"]).cast("long").alias("repeated_words"), text.alias("spans"))
