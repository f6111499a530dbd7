"""Fill-in-the-middle: texts are cut into prefix, middle and suffix at token boundaries and put together in another order.

A token is a word with the blanks before it; blanks at the very end are a token too. Each text is laid over blocks of fixed
size, and a Fenwick tree over the blocks holds how many tokens end, and how many code points begin, in them. A cut behind
the k-th token is found by binary lifting: the descent adds up whole blocks while fewer than k tokens end in them, which
leaves the block that holds the cut and the code points before it; only that block is then looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotsage.llm.common import id_column, is_blank, pieces

#: Bytes of a block.
BLOCK = 1024
# The marks before prefix, suffix and middle; the seed; percents of texts that are cut, and of these in SPM order.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By byte: whether a token ends there."""
    blank = is_blank(data)
    ends = ~blank
    ends[:-1] &= blank[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    ends[last] = True
    return ends


class Fenwick:
    """Sums of tokens and code points over blocks of one text."""

    def __init__(self, counts: np.ndarray):
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(counts, axis=0)])
        at = np.arange(1, len(sums))
        self.tree = np.zeros_like(sums)
        self.tree[1:] = sums[1:] - sums[at - (at & -at)]
        self.size = len(counts)

    def total(self) -> int:
        """All tokens."""
        found, at = 0, self.size
        while at:
            found += int(self.tree[at, 0])
            at -= at & -at
        return found

    def block_of(self, k: int) -> tuple[int, int, int]:
        """The block in which the k-th token (from 1) ends, and the tokens and code points before that block."""
        at, tokens, chars = 0, 0, 0
        step = 1 << self.size.bit_length()
        while step := step >> 1:
            if at + step <= self.size and tokens + self.tree[at + step, 0] < k:
                at += step
                tokens += int(self.tree[at, 0])
                chars += int(self.tree[at, 1])
        return at, tokens, chars


def cut_at(tree: Fenwick, k: int, ends: np.ndarray, leads: np.ndarray) -> tuple[int, int]:
    """Bytes and code points up to the end of the k-th token; ends and leads are those of the text's bytes."""
    if not k:
        return 0, 0
    block, tokens, chars = tree.block_of(k)
    begin = block * BLOCK
    stop = begin + int(np.flatnonzero(ends[begin : begin + BLOCK])[k - tokens - 1]) + 1
    return stop, chars + int(np.count_nonzero(leads[begin:stop]))


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output of each row of docs.

    Four numbers of a hash of seed and doc_id decide: where prefix and middle end, whether the text is cut, and in which
    order. Null and empty texts are plain with 0 tokens, and their output is empty; so are, as they are, texts that hold one of the
    marks. A null doc_id hashes as no digits; rows of one doc_id and text are cut alike. Very long texts are cut whole, in
    memory of a few times their bytes. Other columns are left out, whatever their names; an empty table gives an empty result.
    """
    hashed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    full = docs.select(id_column(docs)[0].alias("doc_id"), text.alias("text"), hashed.alias("hashed"), marked.alias("marked"))
    h = [F.conv(F.substring("hashed", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    form = F.when((F.col("text") == "") | F.col("marked") | (h[2] % 100 >= CUT_PERCENT), "plain").when(h[3] % 100 < SPM_PERCENT, "spm").otherwise("psm")
    asked = full.select("doc_id", "text", h[0].alias("first"), h[1].alias("second"), form.alias("form"))
    marks = {m: m.encode() for m in (PREFIX, SUFFIX, MIDDLE)}

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column("text")):
                ends, leads = token_ends(data, offsets), (data & 0xC0) != 0x80
                sizes = np.diff(offsets)
                n_blocks = -(-sizes // BLOCK)
                first = np.concatenate([[0], np.cumsum(n_blocks)])
                starts = np.repeat(offsets[:-1] - first[:-1] * BLOCK, n_blocks) + np.arange(first[-1]) * BLOCK
                counts = np.stack([np.add.reduceat(x.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64) for x in (ends, leads)], axis=1)
                forms = batch.column("form").slice(at, to - at)
                one, two = (batch.column(c).slice(at, to - at).to_pylist() for c in ("first", "second"))
                n, prefix, middle, out = [], [], [], []
                for i, kind in enumerate(forms.to_pylist()):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    tree = Fenwick(counts[first[i] : first[i + 1]])
                    n.append(tree.total())
                    whole = data[lo:hi].tobytes()
                    if kind == "plain":
                        prefix.append(None)
                        middle.append(None)
                        out.append(whole)
                        continue
                    a, b = sorted((one[i] % (n[-1] + 1), two[i] % (n[-1] + 1)))
                    (a, a_chars), (b, b_chars) = (cut_at(tree, k, ends[lo:hi], leads[lo:hi]) for k in (a, b))
                    prefix.append(a_chars)
                    middle.append(b_chars - a_chars)
                    told = {PREFIX: whole[:a], MIDDLE: whole[a:b], SUFFIX: whole[b:]}
                    out.append(b"".join(marks[m] + told[m] for m in ((SUFFIX, PREFIX, MIDDLE) if kind == "spm" else (PREFIX, SUFFIX, MIDDLE))))
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), long(n), forms, long(prefix), long(middle), pa.array(out, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return asked.mapInArrow(run, f"doc_id {id_column(docs)[1]}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that was transformed, from form and output alone: marks do not occur within cut texts."""

    def between(begin: str, end: str | None) -> Column:
        start = F.instr(output, begin) + len(begin)
        stop = F.instr(output, end) if end else F.char_length(output) + 1
        return F.substring(output, start, stop - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame) -> DataFrame:
    """transformed with hashes of output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c, 256)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def digest_sql() -> str:
    """The same in DuckDB's SQL."""
    number = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    joined = lambda units: f"coalesce(array_to_string({units}, ''), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM d),
v AS (SELECT *, len(units) AS n, CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {number(2)} % 100 >= {CUT_PERCENT} THEN 'plain' WHEN {number(3)} % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, least({number(0)} % (n + 1), {number(1)} % (n + 1)) AS a, greatest({number(0)} % (n + 1), {number(1)} % (n + 1)) AS b FROM v),
w AS (SELECT doc_id, t, n, form, {joined("units[1:a]")} AS p, {joined("units[a + 1:b]")} AS m, {joined("units[b + 1:n]")} AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM w"""
