"""Language-model scores by a weighted backoff automaton of smoothed word n-grams.

States are the n-grams of fewer than ORDER words seen in training, numbered; a state has an arc for each word seen after
it, weighted with the smoothed log-probability, and a failure arc to the state of one word less, weighted with what
smoothing leaves for words unseen after it. The root has an arc for every word, unseen ones too. A text is read once from
left to right: the state is carried along, and the weights of all arcs taken are summed. With Dirichlet smoothing,
p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m), so the failure arc of h weighs m / (c(h) + m).

The automaton of a large corpus fits no task. Texts are gathered into blocks; each block asks for the counts of the
n-grams that it holds, gets its own part of the automaton back, and scores its texts with that. n-grams are dealt to
shards by hash, where the counts of all blocks are summed; all of them are counted, however rare.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import byte_table, cut, cut_by, id_column, lists, mix64, numbers, pieces, remainder, words

ORDER, MASS = 3, 64.0  # of 4, 16 and 64 the mass of least held-out perplexity on sf0.01
#: Bytes of text of a block (one long text may be more), and n-grams of a shard.
BLOCK_BYTES, SHARD_GRAMS = 8 << 20, 1 << 21
#: Bytes that one task of a shuffle should read at most.
TASK_BYTES = 64 << 20
END, BEGIN = (numbers(n, 1)[0] for n in (41, 42))
#: Texts are read in stretches of so many tokens, side by side.
STRETCH = 64


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed: small numbers shrink to a fraction."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted hashes by their steps, which have fewer bits than themselves."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the place of each value among them, and one index at which each stands."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], place, order[new]


def blocks_of(docs: DataFrame, kind: str) -> DataFrame:
    """One row for each block: ids of its texts, held, where each begins in tokens, and tokens as places in the vocabulary.

    Each text is BEGIN, its words in lower case (A-Z), END.
    """
    table = byte_table(lower=True)

    def flush(ids, held, parts, counts):
        hashes = np.concatenate(parts)
        vocabulary, place, _ = ranked(hashes)
        times = np.bincount(place)
        rank = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
        order = np.empty(len(rank), np.uint32)
        order[rank] = np.arange(len(rank), dtype=np.uint32)
        begins = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        ids, held = pa.concat_arrays(ids), pa.concat_arrays(held)
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        row = [whole(ids), whole(held), lists(begins.astype(np.int32), np.array([0, len(begins)])), pa.array([pack(vocabulary[rank])]), pa.array([pack(order[place])])]
        return pa.RecordBatch.from_arrays(row, names=["texts", "held", "begins", "vocabulary", "tokens"])

    def run(batches):
        ids, held, parts, counts, size = [], [], [], [], 0
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column("text")):
                hashes, _, _, firsts = words(data, offsets, table)
                n = np.diff(firsts)
                out = np.empty(len(hashes) + 2 * len(n), np.uint64)
                begins = firsts[:-1] + 2 * np.arange(len(n))
                out[np.arange(len(hashes)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = hashes
                out[begins] = BEGIN
                out[begins + n + 1] = END
                ids.append(batch.column("doc_id").slice(at, to - at))
                held.append(batch.column("held").slice(at, to - at))
                parts.append(out)
                counts.append(n + 2)
                size += len(data) + 16 * len(n)
                if size >= BLOCK_BYTES:
                    yield flush(ids, held, parts, counts)
                    ids, held, parts, counts, size = [], [], [], [], 0
        if ids:
            yield flush(ids, held, parts, counts)

    return docs.mapInArrow(run, f"texts array<{kind}>, held array<boolean>, begins array<int>, vocabulary binary, tokens binary")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's vocabulary (hashes), its tokens as places in that, the text of each token, and where texts begin."""
    begins = np.asarray(row["begins"], np.int64)
    tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
    return unpack(row["vocabulary"], np.uint64), tokens, np.repeat(np.arange(len(begins) - 1), np.diff(begins)), begins


def gram_keys(hashes: np.ndarray, text: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of that order that lie within one text, by the tokens at which they end; and those tokens."""
    if order == 1:
        return hashes, np.arange(len(hashes))
    ends = np.flatnonzero(text[order - 1 :] == text[: len(text) - order + 1]) + order - 1
    out = hashes[ends] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, order):
        out += hashes[ends - k] * numbers(50 + k, 1)[0]
    return mix64(out), ends


ASKED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def asked(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """shard, block, n (order), keys and counts (in training) of each block's n-grams."""
    low = np.uint64(64 - int(math.log2(shards)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, text, _ = opened(row)
                hashes = vocabulary[tokens]
                learns = ~np.asarray(row["held"], bool)[text]
                for n in range(1, order + 1):
                    keys, ends = gram_keys(hashes, text, n)
                    keys, place, _ = ranked(keys)
                    counts = np.bincount(place, learns[ends], minlength=len(keys)).astype(np.uint32)
                    edges = np.searchsorted(keys >> low, np.arange(shards + 1, dtype=np.uint64)) if shards > 1 else np.array([0, len(keys)])
                    out = []
                    for s in np.flatnonzero(np.diff(edges)):
                        part = slice(edges[s], edges[s + 1])
                        out.append({"shard": int(s), "block": row["block"], "n": n, "keys": pack_sorted(keys[part]), "counts": pack(counts[part])})
                    yield pa.RecordBatch.from_pylist(out, ASKED)

    return blocks.mapInArrow(run, "shard int, block long, n int, keys binary, counts binary")


ANSWER = "block long, n int, shard int, counts binary, tokens long, types long"


def answer(table: pa.Table) -> pa.Table:
    """Sum the counts of one order in one shard over all blocks, and give each block those that it asked for."""
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
    lengths = [len(k) for k in keys]
    all_keys, place, _ = ranked(np.concatenate(keys))
    del keys
    total = np.bincount(place, counts, minlength=len(all_keys)).astype(np.uint32)
    parts = np.split(total[place], np.cumsum(lengths)[:-1])
    begin = int(total[all_keys == BEGIN].sum())  # is no token
    one = table.column("n")[0].as_py() == 1
    first = lambda x: pa.array([int(x) if one else 0] + [0] * (len(parts) - 1), pa.int64())
    return pa.table({"block": table.column("block"), "n": table.column("n"), "shard": table.column("shard"), "counts": pa.array([pack(p) for p in parts], pa.binary()), "tokens": first(total.sum(dtype=np.int64) - begin), "types": first((total > 0).sum() - (begin > 0))})


class Automaton:
    """The part of the automaton that a block's texts can reach. State 0 is the root; words are places in the vocabulary.

    arc_key: state * n_words + word, sorted; arc_weight and arc_to: log10 weight and state at the end of each arc;
    fail_weight and fail_to: the failure arc of each state.
    """

    def __init__(self, tokens: np.ndarray, text: np.ndarray, vocabulary: np.ndarray, counts: list[np.ndarray], mass: float, n_all: int, n_types: int):
        order, self.n_words = len(counts), len(vocabulary)
        hashes = vocabulary[tokens]
        fail_weight, fail_to, keys, weights, ends_at = [np.zeros(1)], [np.zeros(1, np.int32)], [], [], []
        first_state = 1  # of the n-grams of this order; those that training lacks are numbered, but no arc leads there
        for n in range(1, order + 1):
            gram_hashes, ends = gram_keys(hashes, text, n)
            _, place, one = ranked(gram_hashes)
            del gram_hashes
            seen, at = counts[n - 1].astype(float), ends[one]  # a token at which each n-gram ends
            if n == 1:
                p = (seen + 1) / (n_all + n_types + 1)
                known, history, suffix = np.ones(len(seen), bool), np.zeros(len(seen), np.int64), np.zeros(len(seen), np.int32)
                self.known, self.word_p = seen[place] > 0, p[place]
            else:
                known = seen > 0
                before, shorter = last_at[at - 1], last_at[at]
                p = (seen + mass * last_p[shorter]) / (last_seen[before] + mass)
                history, suffix = before.astype(np.int64) + last_first, np.where(last_seen[shorter] > 0, shorter + last_first, 0).astype(np.int32)
            key = history[known] * self.n_words + tokens[at[known]]
            sort = np.argsort(key)  # states of longer n-grams have larger numbers: the parts are in order as well
            keys.append(key[sort])
            weights.append(np.log10(p[known])[sort])
            own = np.where(seen > 0, np.arange(first_state, first_state + len(seen)), 0).astype(np.int32) if n < order else suffix
            ends_at.append(own[known][sort])
            if n < order:
                fail_weight.append(np.log10(mass / (seen + mass)))
                fail_to.append(suffix)
                last_at = np.full(len(tokens), -1, np.int32)  # the n-gram that ends at each token
                last_at[ends] = place
                last_first, last_seen, last_p = first_state, seen, p
            first_state += len(seen)
        del key, sort, own, place, ends, at, one, history, suffix
        self.arc_key = np.concatenate(keys)
        del keys
        self.arc_weight = np.concatenate(weights)
        del weights
        self.arc_to = np.concatenate(ends_at)
        self.fail_weight, self.fail_to = np.concatenate(fail_weight), np.concatenate(fail_to)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one word in each state: the weights of the arcs taken, failure arcs included, and the states after."""
        weight, state = np.zeros(len(state)), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_] * self.n_words + word[open_]
            arc = np.searchsorted(self.arc_key, key)
            arc[arc == len(self.arc_key)] = 0
            hit = self.arc_key[arc] == key
            done, arc = open_[hit], arc[hit]
            weight[done] += self.arc_weight[arc]
            state[done] = self.arc_to[arc]
            open_ = open_[~hit]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail_to[state[open_]]
        return weight, state

    def read(self, tokens: np.ndarray, begins: np.ndarray, order: int) -> np.ndarray:
        """The summed weights of each text (BEGIN is read, but is no token), from left to right.

        Stretches of texts are read side by side. A stretch within a text comes into its state by the order - 1 words
        before it, from the root: no state remembers more of the words read.
        """
        n_stretches = -(-(np.diff(begins) - 1) // STRETCH)
        text = np.repeat(np.arange(len(begins) - 1), n_stretches)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_stretches) - n_stretches, n_stretches)
        first = begins[text] + 1 + nth * STRETCH
        last = np.minimum(first + STRETCH, begins[text + 1])
        at = np.maximum(first - max(order - 1, 0), begins[text])
        longest = np.argsort(at - last, kind="stable")  # those still to read are always the first
        text, first, last, at = text[longest], first[longest], last[longest], at[longest]
        state, total, left = np.zeros(len(text), np.int64), np.zeros(len(text)), last - at
        for step in range(int(left.max(initial=0))):
            live = slice(0, int(np.searchsorted(-left, -step, side="left")))
            where = at[live] + step
            weight, state[live] = self.step(state[live], tokens[where])
            total[live] += np.where(where >= first[live], weight, 0.0)
        return np.bincount(text, total, minlength=len(begins) - 1)


SCORE = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_block(order: int, mass: float, n_all: int, n_types: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        vocabulary, tokens, text, begins = opened(row)
        right = right.sort_by([("n", "ascending"), ("shard", "ascending")])
        which, packed = right.column("n").to_numpy(), right.column("counts")
        counts = [np.concatenate([unpack(packed[int(i)].as_py(), np.uint32) for i in np.flatnonzero(which == n)] or [np.zeros(0, np.uint32)]) for n in range(1, order + 1)]
        model = Automaton(tokens, text, vocabulary, counts, mass, n_all, n_types)
        real = np.ones(len(tokens), bool)
        real[begins[:-1]] = False
        sums = lambda x: np.add.reduceat(np.where(real, x, 0), begins[:-1])
        return pa.table({
            "doc_id": left.column("texts").combine_chunks().flatten(), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": (np.diff(begins) - 1).astype(np.int64), "n_known": sums(model.known).astype(np.int64),
            "train_tokens": np.full(len(begins) - 1, n_all, np.int64), "base_score": sums(np.log10(model.word_p)), "score": model.read(tokens, begins, order),
        })

    return run


def score(docs: DataFrame, order: int = ORDER, mass: float = MASS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Learns from rows whose crc32 of the id modulo 7 is not 2 (a null id is learnt from). Null and empty texts are one
    token, the end. Repeated rows are counted and scored as often as they occur; other columns are left out; an empty
    table gives an empty result. Scores are log10 probabilities; base_score is that of single words.
    """
    spark = docs.sparkSession
    held = remainder(F.col("doc_id"), 7) == 2
    doc_id, kind = id_column(docs)
    own = docs.select(doc_id.alias("doc_id"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # in buckets by block: what comes back to the blocks is shuffled to where they lie, they themselves never
    blocks = cut_by(blocks_of(own, kind).withColumn("block", F.monotonically_increasing_id()), "lm-blocks", "block", max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // TASK_BYTES)))
    size = blocks.agg(F.sum(F.element_at("begins", -1).cast("long"))).first()[0] or 0
    shards = 1 << max(3, math.ceil(math.log2(max(1, size) * order / SHARD_GRAMS)))
    # about eight bytes for each n-gram that is asked for
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * order * 8 // TASK_BYTES))
    asks = asked(blocks, order, shards).repartition(n_tasks, "shard", "n")
    counted = cut(asks.groupBy("shard", "n").applyInArrow(answer, ANSWER), "lm-counts")
    n_all, n_types = counted.agg(F.sum("tokens"), F.sum("types")).first()
    run = score_block(order, mass, n_all or 0, n_types or 0)
    return blocks.groupBy("block").cogroup(counted.select("block", "n", "shard", "counts").groupBy("block")).applyInArrow(run, f"doc_id {kind}, {SCORE}")
