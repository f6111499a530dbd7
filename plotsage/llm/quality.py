"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Words are hashed to buckets, their log counts scaled to length one; statistics of structure and the length (metadata)
are standardised features beside them. Pairwise interactions have low rank and are summed in linear time:
sum over i < j of <v_i, v_j> x_i x_j = half of (sum of v x) squared less the sum of v squared x squared, by factor.
The model is fitted on a bounded sample of labelled rows and then scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import byte_table, is_blank, mix64, pieces, remainder, words

BUCKETS, RANK = 1 << 12, 8
#: Labelled rows that the fit may use: those of the smallest hashes of their id.
SAMPLE_ROWS = 12_000
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.02, 1e-4
THRESHOLD = 0.7
STATISTICS = ("log_words", "log_chars", "mean_word", "distinct", "repeat", "top_word", "upper", "digit", "mark", "rare_mark", "line_words", "ended", "non_ascii")


def statistics(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Structure statistics of each text; all in sizes that do not depend on the batch."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    n_words = np.diff(firsts).astype(float)
    one = np.maximum(size, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    blank = share(is_blank(data))
    upper = share((data >= 65) & (data <= 90))
    digit = share((data >= 48) & (data <= 57))
    letter_like = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    mark = size - blank - digit - share(letter_like)
    common = share(np.isin(data, np.frombuffer(b".,'-", np.uint8)))
    lines = share(data == 10) + 1
    ended = share((data == 46) | (data == 63) | (data == 33))
    distinct = np.bincount(owner, minlength=n).astype(float)
    top = np.zeros(n)
    if len(owner):
        begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top[owner[begins]] = np.maximum.reduceat(counts, begins)
    repeats = np.zeros(n)
    if len(hashes) > 1:
        text_of = np.repeat(np.arange(n), np.diff(firsts))
        same = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
        repeats = np.bincount(text_of[1:][same], minlength=n).astype(float)
    w = np.maximum(n_words, 1)
    return np.stack([np.log1p(n_words), np.log1p(size), (size - blank) / w, distinct / w, repeats / w, top / w, upper / one, digit / one, mark / one, (mark - common) / one, np.log1p(n_words / lines), ended / w, share(data >= 128) / one], axis=1)


def features(texts: pa.Array, table: np.ndarray):
    """Runs of texts: (first, last, statistics, owner, bucket, value), the last three for each distinct bucket of a text."""
    for at, to, data, offsets in pieces(texts):
        hashes, _, _, firsts = words(data, offsets, table)
        text_of = np.repeat(np.arange(to - at, dtype=np.uint64), np.diff(firsts))
        keys = (text_of << np.uint64(32)) | (mix64(hashes ^ np.uint64(5)) & np.uint64(BUCKETS - 1))
        pairs, counts = np.unique(keys, return_counts=True)
        owner, bucket = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        value = np.log1p(counts)
        norm = np.sqrt(np.bincount(owner, value * value, minlength=to - at))
        yield at, to, statistics(data, offsets, hashes, firsts, counts, owner), owner, bucket, (value / norm[owner] if len(owner) else value)


class Machine:
    """Weights of a factorisation machine: index 0..BUCKETS-1 hashed words, then the statistics."""

    def __init__(self, seed: int = 11):
        draw = np.random.default_rng(seed)
        n = BUCKETS + len(STATISTICS)
        self.bias, self.w, self.v = 0.0, np.zeros(n), draw.normal(0, 0.05, (n, RANK))
        self.mean, self.scale = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))

    def inputs(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray):
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / 2
        n, k = z.shape
        return np.concatenate([owner, np.repeat(np.arange(n), k)]), np.concatenate([bucket, np.tile(BUCKETS + np.arange(k), n)]), np.concatenate([value, z.ravel()])

    def margins(self, n: int, owner: np.ndarray, index: np.ndarray, value: np.ndarray):
        out = self.bias + np.bincount(owner, self.w[index] * value, minlength=n)
        sums = np.empty((n, RANK))
        for f in range(RANK):
            vx = self.v[index, f] * value
            sums[:, f] = np.bincount(owner, vx, minlength=n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(owner, vx * vx, minlength=n))
        return out, sums

    def scores(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(len(stats), *self.inputs(stats, owner, bucket, value))[0], -40, 40)))

    def fit(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, label: np.ndarray, seed: int = 12) -> Machine:
        """Adam on the logistic loss. owner must be sorted."""
        n = len(label)
        if not n or label.min() == label.max():
            self.bias = 4.0 if not n or label.max() else -4.0
            return self
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        self.bias = float(np.log(label.mean() / (1 - label.mean())))
        draw = np.random.default_rng(seed)
        begin = np.searchsorted(owner, np.arange(n + 1))
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.w, self.v)]
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(n)
            for at in range(0, n, BATCH):
                rows = order[at : at + BATCH]
                length = begin[rows + 1] - begin[rows]
                take = np.repeat(begin[rows] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                o, i, x = self.inputs(stats[rows], np.repeat(np.arange(len(rows)), length), bucket[take], value[take])
                out, sums = self.margins(len(rows), o, i, x)
                g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - label[rows]) / len(rows)
                gx = g[o] * x
                gw = np.bincount(i, gx, minlength=len(self.w)) + DECAY * self.w
                gv = np.stack([np.bincount(i, gx * (sums[o, f] - self.v[i, f] * x), minlength=len(self.w)) for f in range(RANK)], axis=1) + DECAY * self.v
                step += 1
                self.bias -= RATE * float(g.sum())
                for p, grad, (m, s) in ((self.w, gw, moments[0]), (self.v, gv, moments[1])):
                    m *= 0.9
                    m += 0.1 * grad
                    s *= 0.999
                    s += 0.001 * grad * grad
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on at most sample_rows labelled rows whose remainder is not 2; ties and repeated rows count as they are.

    Where ids occur more than once in docs, the bound holds for the rows that are found."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")).filter("label in (0, 1) and id is not null")
    known = known.filter(remainder(F.col("id"), 4) != 2)
    # the bound comes before the join with the texts: what is joined and gathered stays bounded
    chosen = known.orderBy(F.xxhash64("id", F.lit(3)), "id", "label").limit(sample_rows)
    table = byte_table(lower=False)

    def extract(batches):
        for batch in batches:
            for at, to, stats, owner, bucket, value in features(batch.column("text"), table):
                ends = np.searchsorted(owner, np.arange(to - at + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (bucket.astype(np.int16), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, to - at), batch.column("label").slice(at, to - at), pa.array(list(stats)), *lists], names=["id", "label", "stats", "bucket", "value"])

    joined = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")  # bounded by sample_rows
    joined = joined.orderBy(F.xxhash64("id", F.lit(3)), F.xxhash64("text"), "label").limit(sample_rows).select(F.col("id").cast("string").alias("id"), "label", "text")
    rows = joined.mapInArrow(extract, "id string, label double, stats array<double>, bucket array<smallint>, value array<float>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    if not len(rows):
        return Machine().fit(np.zeros((0, len(STATISTICS))), *[np.zeros(0, int)] * 2, np.zeros(0), np.zeros(0))
    buckets, values = rows.column("bucket").combine_chunks(), rows.column("value").combine_chunks()
    owner = np.repeat(np.arange(len(rows)), buckets.value_lengths().to_numpy())
    stats = rows.column("stats").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    return Machine().fit(stats, owner, buckets.flatten().to_numpy().astype(np.int64), values.flatten().to_numpy().astype(float), rows.column("label").to_numpy())


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """The columns of docs by place (c0, c1, ...), whatever their names, and score."""
    table = byte_table(lower=False)
    at_text = docs.columns.index("text")
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        for batch in batches:
            out = np.zeros(len(batch))
            for at, to, *x in features(batch.column(at_text), table):
                out[at:to] = model.scores(*x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "score"])

    return inner.mapInArrow(run, inner.withColumn("score", F.lit(0.0)).schema)


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    Null and empty texts have the same defined score, that of a text without words. Labels, lang, source and doc_id are
    no inputs. Null doc_ids (held_out false) and repeated rows are kept; other columns are left out; an empty table gives
    an empty result.
    """
    known = scored(docs.select("doc_id", "text"), model)
    return known.select(F.col("c0").alias("doc_id"), (remainder(F.col("c0"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, of whatever names.

    Null and empty texts have the score of a text without words; equal rows are kept or go together; an empty table gives
    an empty result."""
    return scored(docs, model).filter(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
