"""Secret scan: base patterns, and a battery of randomness tests with false-discovery control by length.

Long words of letters and digits are candidates. Their encoding is inferred from their characters; a chi-squared test of
even use of that alphabet, a runs test about its middle and a test of serial correlation each ask whether the symbols could
be drawn evenly and independently, and their p-values are combined into one. Words that the battery calls not random are
left alone. Of the others the question is which of two laws their statistics follow better: that of words drawn evenly from
the alphabet, or that of ordinary words of the same encoding and length, which are strung together from the corpus' own short
words. Each law is a normal one of the battery's signed statistics, fitted by encoding and length; the logarithm of their
ratio is a word's score, and its distribution over ordinary words is the null by which the Benjamini-Hochberg rule picks, over
the different words of the whole corpus, those to report. A short word has little to tell such laws apart, and few such are found.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotsage.llm.common import byte_table, cut, id_column, pieces, words

KINDS = ("assign", "access", "hex")
RANDOM = "random"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of 16 and more characters among all runs
WORDLIKE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A text that none of these finds has nothing to report; they run in the Arrow library.
HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[A-Za-z0-9+/_=-]{16}"""

# The symbols of each encoding, the narrowest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "UPPER": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
NAMES = list(ALPHABETS)
#: By encoding and byte: the symbol's place, 255 for others.
PLACE = np.full((len(NAMES), 256), 255, np.uint8)
for _i, _symbols in enumerate(ALPHABETS.values()):
    PLACE[_i, np.frombuffer(_symbols.encode(), np.uint8)] = np.arange(len(_symbols))

LEAST = 16
#: Rate of false discoveries; the combined p-value below which the battery calls a word not random, whatever its score. The
#: score only knows how ordinary words differ from random ones, not how woven or counted ones do, so this is not left to chance:
#: about a hundredth of all random words is given up for it.
RATE, LEAST_P = 0.01, 0.01
#: Words that are drawn from each of the two laws of a stratum, to fit them: how often that is done, no part of the corpus. What
#: ordinary words are made of is drawn from all occurrences of all short words.
NULL_WORDS = 2048
#: The share of the null whose scores give the tail: beyond it, chances fall off exponentially by the mean excess.
TAIL = 0.05
#: Lengths that share a null are those from one step to the next; longer words use the last.
STEPS = np.array([*range(16, 41), 44, 48, 56, 64, 80, 96, 128, 192, 256, 512])
LAGS = 4
#: Statistics beyond it count as it; what is added to their variances; the bins of scores: how wide, and up to what.
Z_MOST, RIDGE, BIN, SCORE_MOST = 8.0, 0.1, 0.1, 40.0


def encoding(word: str) -> str | None:
    """The narrowest alphabet that holds the word, padding left out."""
    symbols = np.frombuffer(word.rstrip("=").encode(), np.uint8)
    fits = (PLACE[:, symbols] < 255).all(1)
    return NAMES[int(np.argmax(fits))] if fits.any() else None


def two_sided(z: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(np.abs(z) / math.sqrt(2)) if z.size else z


def statistics(x: np.ndarray, k: int) -> np.ndarray:
    """Normal deviates of words of one length (rows of places in an alphabet of k symbols) from even, independent symbols.

    Columns: chi-squared (unevenness of use), runs about the middle, serial correlation by lag up to LAGS."""
    rows, n = x.shape
    counts = np.bincount((np.arange(rows)[:, None] * k + x).ravel(), minlength=rows * k).reshape(rows, k)
    chi = ((counts - n / k) ** 2).sum(1) / (n / k)
    # mean and variance of the statistic are exact for small n, where the usual approximation is not
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    above = x >= k / 2
    ups = above.sum(1).astype(float)
    mean = 1 + 2 * ups * (n - ups) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    # symbols of one half alone are the least mixed
    z_runs = np.where(variance > 0, (1 + (above[:, 1:] != above[:, :-1]).sum(1) - mean) / np.sqrt(np.where(variance > 0, variance, 1)), -math.sqrt(n))
    centred = x - (k - 1) / 2
    z_serial = [(centred[:, j:] * centred[:, :-j]).sum(1) / ((k * k - 1) / 12 * math.sqrt(n - j)) for j in range(1, LAGS + 1)]
    return np.stack([z_chi, z_runs, *z_serial], axis=1)


def battery(z: np.ndarray) -> np.ndarray:
    """P-values of the three tests. Columns: chi-squared, whose use may be neither too uneven nor too even; runs; serial
    correlation, of the lags the most telling (by Sidak's rule)."""
    return np.stack([two_sided(z[:, 0]), two_sided(z[:, 1]), sidak(two_sided(z[:, 2:].T))], axis=1)


def sidak(p: np.ndarray) -> np.ndarray:
    """One p-value of several (the first axis): that of their least. No test can make up for another."""
    return -np.expm1(len(p) * np.log1p(-np.minimum(p.min(0), 1 - 1e-12)))


def measured(found: list[str], name: str) -> np.ndarray:
    """The statistics of words of one encoding and length."""
    x = PLACE[NAMES.index(name)][np.frombuffer("".join(found).encode(), np.uint8)].reshape(len(found), -1).astype(np.int64)
    return statistics(x, len(ALPHABETS[name]))


def maybe_random(z: np.ndarray) -> np.ndarray:
    """Whether the combined tests leave it open that a word is random."""
    return sidak(battery(z).T) >= LEAST_P


class Normal(NamedTuple):
    """A normal law of statistics."""

    mean: np.ndarray
    precision: np.ndarray
    log_volume: float

    @staticmethod
    def of(sample: np.ndarray) -> Normal:
        sample = np.clip(sample, -Z_MOST, Z_MOST)
        spread = np.cov(sample.T) + RIDGE * np.eye(sample.shape[1])
        return Normal(sample.mean(0), np.linalg.inv(spread), float(np.linalg.slogdet(spread)[1]))

    def log_density(self, z: np.ndarray) -> np.ndarray:
        off = np.clip(z, -Z_MOST, Z_MOST) - self.mean
        return -0.5 * ((off @ self.precision * off).sum(1) + self.log_volume)


def step_of(length: int) -> int:
    return int(STEPS[np.searchsorted(STEPS, length, side="right") - 1])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, word without padding) of the long words that meet no base span."""
    out, at = [], 0
    reach = np.maximum.accumulate([e for _, _, e in base]) if base else []
    for m in WORDLIKE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][0] < end:
            at += 1
        # base spans that begin before the word ends: the farthest of their ends
        if (not at or reach[at - 1] <= start) and len(word := m[0].rstrip("=")) >= LEAST:
            out.append((start, end, word))
    return out


BASE_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
MORE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("word", pa.int64()), ("z", pa.list_(pa.float64()))]))
SCANNED = "base array<struct<kind:string,start:int,end:int>>, more array<struct<start:int,end:int,stratum:string,word:bigint,z:array<double>>>"


def scan_batches(batches):
    """Base spans, and candidates that the battery leaves open, with their statistics and a hash of the word."""
    for batch in batches:
        texts = batch.column("text").fill_null("")
        hit = np.asarray(pc.match_substring_regex(texts, HINT).to_numpy(zero_copy_only=False), dtype=bool)
        base, more, alike = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))], {}
        for i in np.flatnonzero(hit):
            text = texts[i].as_py()
            spans = base_spans(text)
            base[i] = [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
            for start, end, word in candidates(text, spans):
                if name := encoding(word):
                    row = {"start": start, "end": end, "stratum": f"{name}:{step_of(len(word))}", "word": xxhash.xxh64_intdigest(word) - (1 << 63)}
                    alike.setdefault((name, len(word)), []).append((word, more[i], row))
        for (name, _), found in alike.items():  # words of one encoding and length are tested together
            z = measured([w for w, _, _ in found], name)
            for (_, of, row), values, is_open in zip(found, z.tolist(), maybe_random(z).tolist(), strict=True):
                if is_open:
                    of.append(row | {"z": values})
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, BASE_TYPE), pa.array(more, MORE_TYPE)], names=["doc_id", "base", "more"])


CLASSES = ("lower", "capital", "upper", "digit", "mixed")


def short_words(docs: DataFrame) -> DataFrame:
    """class, hash, word and n: every different ordinary word of 2 to 15 letters and digits, and how often the corpus has it."""
    table = byte_table(lower=False)
    flags = np.zeros((3, 256), np.int64)
    for row, span in zip(flags, ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"), strict=True):
        row[np.frombuffer(span.encode(), np.uint8)] = 1

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                hashes, start, end, _ = words(data, offsets, table, flags.sum(0) > 0)
                short = np.flatnonzero((end - start >= 2) & (end - start < LEAST))
                distinct, first, times = np.unique(hashes[short], return_index=True, return_counts=True)
                start, n = start[short][first], (end - start)[short][first]
                to = np.concatenate([[0], np.cumsum(n)])
                symbols = data[np.arange(to[-1]) + np.repeat(start - to[:-1], n)]
                word = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(symbols.tobytes())])
                low, up, digit = (np.diff(np.concatenate([[0], np.cumsum(f[symbols])])[to]) for f in flags)
                first_up = flags[1][data[start]] == 1 if len(start) else np.zeros(0, bool)
                kind = np.select([low == n, (low == n - 1) & first_up, up == n, digit == n], [0, 1, 2, 3], 4)
                yield pa.RecordBatch.from_arrays([pa.array(CLASSES, pa.string()).take(pa.array(kind, pa.int64())), pa.array((distinct ^ np.uint64(1 << 63)).view(np.int64)), word, pa.array(times, pa.int64())], names=["class", "hash", "word", "n"])

    kept = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "class string, hash long, word string, n long")
    return cut(kept.groupBy("class", "hash").agg(F.min("word").alias("word"), F.sum("n").alias("n")), "secrets-words")


def wanted_classes(name: str) -> list[str]:
    """The classes of which each ordinary word of an encoding has one, as it is known by their symbols."""
    return [c for c, of in (("digit", "0123456789"), ("capital", "Q"), ("lower", "q")) if set(of) & set(ALPHABETS[name]) and not (c != "digit" and name in ("hex", "HEX"))]


def fitter(name: str):
    """What an encoding's alphabet leaves of a word."""
    symbols = set(ALPHABETS[name])
    cased = {"hex": str.lower, "HEX": str.upper, "lower": str.lower, "UPPER": str.upper, "base32": str.upper, "base36": str.lower, "BASE36": str.upper}.get(name, str)
    return lambda w: "".join(c for c in cased(w) if c in symbols)


def strung(name: str, length: int, n: int, wanted: list[str], pick, draw: np.random.Generator) -> list[str]:
    """n words of words that pick gives by class: one of each wanted class and any others, shuffled, joined by marks where the encoding has any."""
    marks = sorted(set(ALPHABETS[name]) & set("+/-_"))
    out: list[str] = []
    for _ in range(n):
        parts = [pick(c) for c in wanted]
        size = sum(map(len, parts))
        while size < length:
            parts.append(pick("any"))
            size += len(parts[-1])
        order = draw.permutation(len(parts))
        joint = marks[int(draw.integers(len(marks)))] if marks else ""
        word = joint.join(parts[i] for i in order)
        at = int(draw.integers(len(word) - length + 1))
        out.append(word[at : at + length])
    return out


#: Null words that are made in one go; even parts of each class's occurrences, by which draws meet words; hashes are summed by their first bits.
GO, BLOCKS, HASH_BITS = 128, 128, 8
#: What identifiers are strung together of is less often in small letters than running text is: classes are drawn by this power of
#: how often they occur, words within a class by how often they occur. Words of mixed classes are often random and keep their share.
CLASS_POWER = 0.4


def draws(stratum: str, totals: dict[str, int], shares: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """What the null words of a stratum are made of: occurrences of short words, each drawn evenly from all that its class has.

    totals: how many these are; shares: how often a class is drawn for any. stream: the class asked for, or any. at: the place among the class's occurrences. A few more are drawn than are needed on average."""
    name, length = stratum.split(":")
    draw, some = np.random.default_rng(abs(hash_of(f"{name}:{length}"))), [c for c in CLASSES if totals.get(c)]
    upto, all_of = np.cumsum([shares[c] for c in some]), np.array([totals[c] for c in some])
    per_word = {c: 2 for c in wanted_classes(name)} | {"any": math.ceil(int(length) * (1.2 if name in ("hex", "HEX") else 1 / 3))}
    for go in range(NULL_WORDS // GO):
        for stream, each in per_word.items():
            u = draw.random(GO * each)
            of = {"capital": "upper"}.get(stream, stream) if stream not in some else stream
            if stream == "any" or (of not in some and stream == "capital"):
                kind = np.searchsorted(upto[:-1], u * upto[-1], side="right")
                at = (draw.random(len(u)) * all_of[kind]).astype(np.int64)
            elif of in some:
                kind, at = np.full(len(u), some.index(of)), (u * totals[of]).astype(np.int64)
            else:
                continue
            size = all_of[kind]
            block = (at.astype(object) * BLOCKS // size).astype(np.int64) if size.max() > 1 << 55 else at * BLOCKS // size
            yield pa.RecordBatch.from_pydict({
                "stratum": [stratum] * len(u), "go": pa.array([go] * len(u), pa.int32()), "stream": [stream] * len(u), "nth": pa.array(np.arange(len(u)), pa.int32()),
                "class": pa.array(some, pa.string()).take(pa.array(kind, pa.int64())), "block": pa.array(block, pa.int64()), "at": pa.array(at, pa.int64()),
            })


def drawn_words(counted: DataFrame, strata: list[str]) -> DataFrame | None:
    """stratum, go, stream, nth and word of all draws(); None if the corpus has no short words.

    counted: short_words(). Its rows get their places among all occurrences of their class; a frequent word lies in many blocks."""
    spark = counted.sparkSession
    sums = counted.groupBy("class", F.shiftright("hash", 64 - HASH_BITS).alias("bits")).agg(F.sum("n").alias("n")).orderBy("class", "bits").collect()  # bounded: classes times 256
    totals, bases = {}, []
    for r in sums:
        bases.append((r["class"], r["bits"], totals.get(r["class"], 0)))
        totals[r["class"]] = totals.get(r["class"], 0) + r["n"]
    if not totals:
        return None
    shares = {c: n**CLASS_POWER for c, n in totals.items() if c != "mixed"}
    if "mixed" in totals:
        shares["mixed"] = (sum(shares.values()) or 1.0) * totals["mixed"] / sum(totals.values())
    base = spark.createDataFrame([(*b, totals[b[0]]) for b in bases], "class string, bits long, base long, total long")
    placed = counted.withColumn("bits", F.shiftright("hash", 64 - HASH_BITS)).join(F.broadcast(base), ["class", "bits"])
    placed = placed.withColumn("to", F.col("base") + F.sum("n").over(Window.partitionBy("class", "bits").orderBy("hash"))).withColumn("from", F.col("to") - F.col("n"))
    placed = placed.select("class", F.explode(F.sequence(F.expr(f"`from` * {BLOCKS} div total"), F.expr(f"(`to` - 1) * {BLOCKS} div total"))).alias("block"), "from", "word")

    def ask(batches):
        for batch in batches:
            for stratum in batch.column(0).to_pylist():
                yield from draws(stratum, totals, shares)

    def meet(have: pa.Table, want: pa.Table) -> pa.Table:
        have = have.sort_by("from")
        at = np.searchsorted(have.column("from").to_numpy(), want.column("at").to_numpy(), side="right") - 1
        return want.select(["stratum", "go", "stream", "nth"]).append_column("word", have.column("word").take(pa.array(at, pa.int64())))

    wanted = spark.createDataFrame([(s,) for s in strata], "stratum string").repartition(min(len(strata), 64), "stratum").mapInArrow(ask, "stratum string, go int, stream string, nth int, class string, block long, at long")
    return placed.groupBy("class", "block").cogroup(wanted.groupBy("class", "block")).applyInArrow(meet, "stratum string, go int, stream string, nth int, word string")


def null_of(streams: dict[str, list[str]], name: str, length: int, go: int) -> list[str]:
    """Null words of drawn words, which are taken one after the other; those that the alphabet leaves nothing of are passed over,
    and a stream that runs out begins again. Where there are none, plain counting stands for digits and the alphabet's first for letters."""
    fitted = fitter(name)
    tidy = {c: [f for w in found if (f := fitted(w))] for c, found in streams.items()}
    tidy["any"] = tidy.get("any") or ["".join(sorted(ALPHABETS[name]))[:9]]
    tidy["digit"] = tidy.get("digit") or ["1", "12", "123", "2000"]
    tidy["capital"] = tidy.get("capital") or tidy["any"]
    turn = {c: itertools.cycle(found) for c, found in tidy.items() if found}
    return strung(name, length, GO, [c for c in wanted_classes(name) if c in turn], lambda c: next(turn[c]), np.random.default_rng(abs(hash_of(f"{name}:{length}")) + go))


def null_words(ordinary: dict[str, list[tuple[str, int]]], name: str, length: int, n: int = NULL_WORDS) -> list[str]:
    """n words of that encoding and length as ordinary writing strings them together: short words (by class, with how often they
    occur), drawn by how often they occur, among them words with the letters and digits that the encoding is known by, and joined
    by marks where it has any. Where there are no such words, plain counting stands for digits and the alphabet's first for letters."""
    fitted = fitter(name)
    pools: dict[str, tuple[list[str], np.ndarray]] = {}
    for c, found in ordinary.items():
        tidy = [(f, t) for w, t in found if (f := fitted(w))]
        if tidy:
            pools[c] = [w for w, _ in tidy], np.cumsum([t for _, t in tidy], dtype=float)
    merged = [(w, t) for ws, ts in pools.values() for w, t in zip(ws, np.diff(ts, prepend=0), strict=True)] or [("".join(sorted(ALPHABETS[name]))[:9], 1.0)]
    pools["any"] = [w for w, _ in merged], np.cumsum([t for _, t in merged])
    pools.setdefault("digit", (["1", "12", "123", "2000"], np.arange(1.0, 5.0)))
    pools.setdefault("capital", pools.get("upper", pools["any"]))
    draw = np.random.default_rng(abs(hash_of(f"{name}:{length}")))
    pick = lambda c: pools[c][0][int(np.searchsorted(pools[c][1], draw.random() * pools[c][1][-1], side="right"))]
    return strung(name, length, n, [c for c in wanted_classes(name) if c in pools], pick, draw)


def hash_of(text: str) -> int:
    return int.from_bytes(text.encode()[-7:], "big")


def random_words(name: str, length: int, n: int = NULL_WORDS) -> list[str]:
    """n words of that length drawn evenly from the alphabet, of those that tell the encoding by their characters (a hundred
    draws of n, at most, are looked through for them; if that gives too few, any draws make up for the rest)."""
    draw, symbols = np.random.default_rng(abs(hash_of(f"{length}:{name}"))), np.array(list(ALPHABETS[name]))
    out: list[str] = []
    for _ in range(100):
        drawn = ["".join(w) for w in symbols[draw.integers(len(symbols), size=(n, length))]]
        out += [w for w in drawn if encoding(w) == name]
        if len(out) >= n:
            return out[:n]
    return (out + drawn)[:n]


class Law(NamedTuple):
    """The two laws of a stratum, and the scores of ordinary words in order."""

    even: Normal
    usual: Normal
    null: np.ndarray

    def score(self, z: np.ndarray) -> np.ndarray:
        """The logarithm of how much likelier words are as random ones than as ordinary ones."""
        return self.even.log_density(z) - self.usual.log_density(z)


def law(ordinary: dict[str, list[tuple[str, int]]], stratum: str) -> Law:
    """Fitted to as many random as ordinary words."""
    name, length = stratum.split(":")
    return law_of(measured(null_words(ordinary, name, int(length)), name), stratum)


def law_of(z: np.ndarray, stratum: str) -> Law:
    """z: the statistics of ordinary words; those that the battery calls not random score 0 at most."""
    name, length = stratum.split(":")
    found = Law(Normal.of(measured(random_words(name, int(length)), name)), Normal.of(z), np.zeros(0))
    score = found.score(z)
    return found._replace(null=np.sort(np.where(maybe_random(z), score, np.minimum(score, 0.0))))


def laws_of(docs: DataFrame, strata: list[str]) -> dict[str, Law]:
    """By stratum. The driver gets some 20 KB a stratum, of which there are as many as encodings times lengths."""

    def make(table: pa.Table) -> pa.Table:
        stratum, go = table.column("stratum")[0].as_py(), table.column("go")[0].as_py()
        streams: dict[str, list[str]] = {}
        for stream, word in zip(*(table.sort_by("nth").column(c).to_pylist() for c in ("stream", "word")), strict=True):
            streams.setdefault(stream, []).append(word)
        name, length = stratum.split(":")
        return pa.table({"stratum": [stratum], "go": pa.array([go], pa.int32()), "z": [measured(null_of(streams, name, int(length), go), name).tobytes()]})

    def fit(table: pa.Table) -> pa.Table:
        stratum = table.column("stratum")[0].as_py()
        z = np.concatenate([np.frombuffer(x).reshape(GO, -1) for x in table.sort_by("go").column("z").to_pylist()])
        return pa.table({"stratum": [stratum], "law": [pickle.dumps(law_of(z, stratum))]})

    def without(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"stratum": batch.column(0), "law": [pickle.dumps(law({}, s)) for s in batch.column(0).to_pylist()]})

    drawn = drawn_words(short_words(docs), strata)
    if drawn is None:
        each = docs.sparkSession.createDataFrame([(s,) for s in strata], "stratum string").mapInArrow(without, "stratum string, law binary")
    else:
        each = drawn.groupBy("stratum", "go").applyInArrow(make, "stratum string, go int, z binary").groupBy("stratum").applyInArrow(fit, "stratum string, law binary")
    return {r["stratum"]: pickle.loads(r["law"]) for r in each.collect()}


def chance(null: np.ndarray, least: float) -> float:
    """That an ordinary word reaches the score: the share of null words that do, and in the tail at least what an
    exponential law of the tail's mean excess says."""
    share = 1 - float(np.searchsorted(null, least)) / len(null)
    edge = float(np.quantile(null, 1 - TAIL))
    if share >= TAIL or least <= edge:
        return share
    beyond = null[null > edge] - edge
    excess = max(float(beyond.mean()), 0.5) if len(beyond) else 0.5
    return max(share, TAIL * math.exp(-(least - edge) / excess))


def least_passing(bins: dict[int, int], null: np.ndarray, rate: float, odds: float = 1.0) -> float | None:
    """The least score that the Benjamini-Hochberg rule lets pass; bins: how many words each has.

    Whatever the rule says, a word must be likelier random than ordinary by the factor odds."""
    total, upto, found = sum(bins.values()), 0, None
    for b in sorted(bins, reverse=True):
        upto += bins[b]
        if b * BIN >= math.log(odds) and chance(null, b * BIN) * total <= rate * upto:
            found = b * BIN
    return found


def rated(laws: dict[str, Law]):
    """A function for batches that puts a score in the place of the statistics."""
    laws = {s: x._replace(null=np.zeros(0)) for s, x in laws.items()}  # the null stays with the driver

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("more").to_pylist()
            alike: dict[str, list[dict]] = {}
            for row in (row for found in flat for row in found):
                alike.setdefault(row["stratum"], []).append(row)
            for stratum, found in alike.items():
                for row, score in zip(found, laws[stratum].score(np.array([row["z"] for row in found])).tolist(), strict=True):
                    row["score"] = score
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("base"), pa.array(flat, RATED_TYPE)], names=["doc_id", "base", "more"])

    return run


RATED_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.string()), ("word", pa.int64()), ("score", pa.float64())]))
RATED = "base array<struct<kind:string,start:int,end:int>>, more array<struct<start:int,end:int,stratum:string,word:bigint,score:double>>"


def find(docs: DataFrame, rate: float = RATE, odds: float = 1.0) -> DataFrame:
    """A row for each row of docs: doc_id, base and more (arrays of kind, start, end; more holds the method's spans).

    rate is that of false discoveries among different words of one encoding and length, as far as ordinary words are put together
    like those of the null. Where they are not (identifiers made of a few words over and over), more may be false; odds above 1
    asks for more evidence of every word then, and finds fewer short ones.

    Positions are code points, the end exclusive. Null and empty texts have no spans; null doc_ids and repeated rows are
    kept; equal words, in one text or in many, count as one in the control of false discoveries; a very long text is scanned
    whole by one task; other columns are left out; an empty table gives an empty result.
    """
    doc_id, kind = id_column(docs)
    scanned = cut(docs.select(doc_id.alias("doc_id"), F.col("text").cast("string")).mapInArrow(scan_batches, f"doc_id {kind}, {SCANNED}"), "secrets-scanned")
    # bounded: encodings times lengths
    strata = sorted(r["stratum"] for r in scanned.select(F.explode("more.stratum").alias("stratum")).distinct().collect())
    laws = laws_of(docs, strata) if strata else {}
    scored = scanned.mapInArrow(rated(laws), f"doc_id {kind}, {RATED}")
    # a word counts once, however many copies of its text there are
    different = scored.select(F.explode("more").alias("x")).groupBy("x.stratum", "x.word").agg(F.max("x.score").alias("score"))
    each = different.groupBy("stratum", F.floor(F.greatest(F.least("score", F.lit(SCORE_MOST)), F.lit(-BIN)) / BIN).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    tallied: dict[str, dict[int, int]] = {}
    for r in each.collect() if strata else []:  # bounded: encodings times lengths times bins
        tallied.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    least = {s: z for s, bins in tallied.items() if (z := least_passing(bins, laws[s].null, rate, odds)) is not None}
    passing = F.create_map(*[F.lit(x) for pair in (least or {"": 0.0}).items() for x in pair])
    kept = F.filter("more", lambda x: F.coalesce(x["score"] >= passing[x["stratum"]], F.lit(False)))
    return scored.select("doc_id", "base", F.transform(kept, lambda x: F.struct(F.lit(RANDOM).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("more"))


def listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (text) of what find() returns."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, RANDOM)) for x in (k, i)])
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    ordered = F.array_sort(F.transform(F.concat("base", "more"), lambda x: F.struct(x["start"].alias("start"), place[x["kind"]].alias("place"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(ordered).alias("spans"))
