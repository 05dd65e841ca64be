"""Shared helpers of the training-data operators: scratch tables, text batches, word hashes."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = frozenset(b" \t\n\x0b\x0c\r")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a temporary one where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """Pauses the collector of reference cycles around code that makes many objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def small_batches(spark: SparkSession, most: int = 1_000) -> None:
    """Rows go to Python workers 1,000 at a time, unless the session asks for fewer: a text is some kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= most:
        spark.conf.set(name, str(most))


class Scratch:
    """Parquet tables under the shared folder that cut lineage between the phases of one operator.

    A lost executor costs only the running phase: finished phases are files in shared storage. The folder goes when
    the driver's JVM ends, single tables as soon as `drop` names them.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.at = spark, f"{shared_dir(spark)}/engram-{name}-{uuid.uuid4().hex[:12]}"
        self._fs().deleteOnExit(self._path(self.at))

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.at).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._path(f"{self.at}/{name}"), True)



def slices(batch: pa.RecordBatch, most_bytes: int = 2 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most about `most_bytes` of text, or one row if that is longer; text: a column or row.field."""
    name, *inner = text.split(".")
    texts = pc.struct_field(batch.column(name), inner) if inner else batch.column(name)
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def rows(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20, text: str = "text") -> Iterator[dict[str, list]]:
    """Column lists of such parts."""
    for batch in batches:
        for part in slices(batch, most_bytes, text):
            yield part.to_pydict()


def keep_rows(docs: DataFrame, choose) -> DataFrame:
    """Rows of `docs`, all columns, for which choose(list of texts) says True; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(choose(part.column("text").to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


# --- vectorised hashing of bytes and words -------------------------------------------------------------------------

_RANDOM = np.random.default_rng(20240607)
BYTE_CODE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Multiplier of the polynomial hashes, odd and so invertible modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
MULTIPLIERS = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); uint64 in and out."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1 << 12, dtype=np.uint64)
_POWERS[1:] = BASE
_POWERS = np.multiply.accumulate(_POWERS)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1)."""
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(n, BASE, dtype=np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


#: Bytes between words: ASCII white space, or all ASCII but letters and digits.
BLANK = np.array([c in SPACE for c in range(256)])
NO_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(texts: list[bytes], between: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, number of words of each text); words are runs of bytes that are not `between`.

    A-Z count as a-z. Words of all texts are hashed in a few passes over their joined bytes.
    """
    joined = b"\n".join([*texts, b""]).translate(LOWER)
    data = np.frombuffer(joined, dtype=np.uint8)
    word = ~between[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    begin, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.array([len(x) + 1 for x in texts], dtype=np.int64))
    counts = np.diff(np.concatenate(([0], np.searchsorted(begin, ends, side="left"))))
    if not len(begin):
        return np.empty(0, dtype=np.uint64), counts
    length = end - begin
    inside = np.flatnonzero(word)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    value = BYTE_CODE[data[inside]] * powers(int(length.max()))[place]
    starts = np.cumsum(length) - length
    return mix(np.add.reduceat(value, starts) + length.astype(np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text's word n-grams, their numbers); a text of fewer words is one n-gram."""
    n = len(words)
    owner = np.repeat(np.arange(len(counts)), counts)
    h = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        h = h * BASE + words[k : k + len(h)]
    ok = owner[: len(h)] == owner[size - 1 : size - 1 + len(h)] if len(h) else np.empty(0, dtype=bool)
    h, who = mix(h[ok]), owner[: len(h)][ok]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        starts = np.cumsum(counts) - counts
        extra = []
        for i in short:
            x = int(counts[i]) * 0x5851F42D4C957F2D
            for w in words[starts[i] : starts[i] + counts[i]].tolist():
                x = x * int(BASE) + w
            extra.append(x & (1 << 64) - 1)
        h, who = np.concatenate((h, mix(np.array(extra, dtype=np.uint64)))), np.concatenate((who, short))
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])))
        h, who = h[first], who[first]
    return h, np.bincount(who, minlength=len(counts)).astype(np.int64)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def heavy_keys(counted: DataFrame, keys: list[str], total: int, share: int = 1_000) -> DataFrame | None:
    """Keys of `counted` (keys, n) that hold more than one `share`-th of `total` rows, fewer than `share`; None if none do."""
    found = counted.where(F.col("n") * share > total).select(*keys).distinct().collect()
    return counted.sparkSession.createDataFrame(found, counted.select(*keys).schema) if found else None


def split_join(rows: DataFrame, found: DataFrame, keys: list[str], heavy: DataFrame | None) -> DataFrame:
    """Inner join of `rows` with the smaller `found`, whose few rows of heavy keys are broadcast and not shuffled."""
    if heavy is None:
        return rows.join(found, keys)
    heavy = F.broadcast(heavy)
    here = rows.join(F.broadcast(found.join(heavy, keys, "left_semi")), keys)
    return here.union(rows.join(heavy, keys, "left_anti").join(found.join(heavy, keys, "left_anti"), keys))


def partition_offsets(parts: DataFrame, keys: list[str]) -> DataFrame:
    """For a table with columns `pid` and `keys`: where each (keys, pid) begins in a gapless numbering within keys."""
    from pyspark.sql import Window as W

    counts = parts.groupBy("pid", *keys).agg(F.count("*").alias("n"))
    before = W.partitionBy(*keys).orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("pid", *keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


WORDS = re.compile(r"\S+")
