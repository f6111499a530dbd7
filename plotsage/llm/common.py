"""What the corpus operators share: cutting lineage, and hashing words in Arrow batches."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotsage.sources.shared import cut, shared_folder  # noqa: F401

#: One word: what lies between blanks. ASCII blanks only, so that bytes and characters agree.
WORD = r"[^\x20\x09-\x0D]+"


def discard(*tables: DataFrame) -> None:
    """Delete what cut() wrote for tables that no later plan reads."""
    for table in tables:
        jvm, spark = table.sparkSession._jvm, table.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As cut(), in buckets of key: grouping the result by key needs no shuffle of it."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(buckets, key).format("parquet").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its entry in the catalog, which the plan needs no more; the files stay
    return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo by; -1 for a null id, which therefore counts as no remainder."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(by)), F.lit(-1))


def id_column(docs: DataFrame) -> tuple[Column, str]:
    """doc_id and its type: long where it is any whole number, else as it is."""
    kind = dict(docs.dtypes)["doc_id"]
    whole = kind in ("tinyint", "smallint", "int", "bigint", "void")
    return (F.col("doc_id").cast("long"), "bigint") if whole else (F.col("doc_id"), kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(of: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64, kept per worker."""
    if len(_powers.get(of, ())) < n:
        steps = np.full(max(n, 1 << 20), of, dtype=np.uint64)
        steps[0] = 1
        _powers[of] = np.multiply.accumulate(steps)
    return _powers[of][:n]


def byte_table(lower: bool) -> np.ndarray:
    table = numbers(77, 256)
    if lower:
        table[65:91] = table[97:123]
    return table


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins (and the last ends). Null is empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if texts.null_count:  # bytes may lie under a null
        lengths = np.diff(offsets) * ~np.asarray(texts.is_null())
        if lengths.sum() != offsets[-1]:
            return text_bytes(texts.fill_null(""))
    return data, offsets


def pieces(texts: pa.Array, size: int = 1 << 20):
    """Runs of texts of about size bytes (a longer text stays whole): small enough for the processor's cache."""
    data, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def is_blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def is_word_byte() -> np.ndarray:
    """By byte: a letter, a digit, or part of a character beyond ASCII."""
    return np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its 64-bit hash, first and last byte (end exclusive); and of each text its first word's index (len + 1).

    A word is a run of bytes that are no blanks, or of those that inside says.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~is_blank(data) if inside is None else inside[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | begins[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begins[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * powers(BASE, n), out=sums[1:])
    return mix64((sums[end] - sums[start]) * powers(BASE_INVERSE, n)[start]), start, end, np.searchsorted(start, offsets)


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """One list for each text, from all values in a row and the index at which each list begins (len + 1)."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
