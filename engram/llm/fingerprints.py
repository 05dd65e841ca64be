"""Lempel-Ziv phrase fingerprints of whole texts (op9).

A text is parsed into phrases, each the shortest string that is not yet in the dictionary. The hashes of a text's
phrases form a set, and 64 minima over that set under as many hash functions, 16 bits kept of each, are the fingerprint.
The share of equal minima of two fingerprints estimates how much of their dictionaries two texts share, which is what
a compressor gains from one when it packs the other.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

LANES = 64
_FACTOR = np.random.default_rng(20240911).integers(1, 1 << 31, LANES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_INVERSE = np.uint64(pow(int(common.BASE), -1, 1 << 64))
NOTHING = np.full(LANES, 0xFFFFFFFF, dtype=np.uint32)
OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Parser:
    """Incremental parse of one text into phrases; `undo` returns to the state at `mark`."""

    def __init__(self):
        self.root: dict = {}
        self.node, self.added, self.marked = self.root, [], None

    def mark(self) -> None:
        self.marked, self.added = self.node, []

    def undo(self) -> None:
        for node, c in reversed(self.added):
            del node[c]
        self.node, self.added = self.marked, []

    def ends(self, text: str, at: int = 0) -> list[int]:
        """Where phrases end that are completed in `text`, which begins at position `at`."""
        root, node, out, i = self.root, self.node, [], at
        keep = self.added.append if self.marked is not None else None
        for c in text:
            i += 1
            after = node.get(c)
            if after is None:
                node[c] = {}
                if keep is not None:
                    keep((node, c))
                out.append(i)
                node = root
            else:
                node = after
        self.node = node
        return out


def _minima(text: str, begins: list[int], ends: list[int]) -> np.ndarray:
    """Minimum of each lane over the phrases text[b:e]."""
    if not ends:
        return NOTHING
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power = common.powers(len(code) + 1)
    total = np.zeros(len(code) + 1, dtype=np.uint64)
    np.cumsum(code * power[:-1], out=total[1:])
    b, e = np.array(begins), np.array(ends)
    inverse = _inverse_powers(len(code) + 1)
    h = common.mix((total[e] - total[b]) * inverse[b] + (e - b).astype(np.uint64))
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    out = NOTHING
    for i in range(0, len(low), 1024):
        x = low[i : i + 1024, None] * _FACTOR
        x ^= x >> np.uint32(15)
        x += high[i : i + 1024, None]
        x *= _FACTOR[::-1]
        out = np.minimum(out, x.min(axis=0))
    return out


_INVERSES = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        more = np.full(max(n, 1 << 12), _INVERSE, dtype=np.uint64)
        more[0] = 1
        _INVERSES = np.multiply.accumulate(more)
    return _INVERSES[:n]


def signature(text: str, edited_tail: str | None = None) -> tuple[np.ndarray, np.ndarray, str]:
    """Lanes of the text and of its edited form, and that form; they share the parse of what both begin with."""
    n = len(text)
    head = text[: n - n // 4]
    parser = Parser()
    shared = parser.ends(head)
    open_at = shared[-1] if shared else 0
    common_part = _minima(head, [0, *shared[:-1]], shared)

    def rest(tail: str) -> np.ndarray:
        ends = parser.ends(tail, len(head))
        piece = head[open_at:] + tail
        if (ends[-1] if ends else open_at) < len(head) + len(tail):
            ends = [*ends, len(head) + len(tail)]  # the last phrase may be one that is in the dictionary
        moved = [e - open_at for e in ends]
        return np.minimum(common_part, _minima(piece, [0, *moved[:-1]], moved))

    parser.mark()
    own = rest(text[len(head) :])
    if edited_tail is None:
        return own, own, text
    parser.undo()
    return own, rest(edited_tail), head + edited_tail


def digest(lanes: np.ndarray) -> str:
    return (lanes >> np.uint32(16)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal 16-bit lanes of two fingerprints."""
    x, y = np.frombuffer(bytes.fromhex(a), dtype=">u2"), np.frombuffer(bytes.fromhex(b), dtype=">u2")
    return float((x == y).mean())


def in_order(docs: DataFrame, scratch: common.Scratch, rows_a_part: int) -> DataFrame:
    """Rows (part, doc_id, text, tie, guard): ranges of doc_id, each closed by the row that follows it, as a guard.

    Null doc_ids come first, equal ones go by a hash of their text. The row after the very last one is the first. Only
    range limits pass the driver, one for each `rows_a_part` rows, and the guards are one row for each range.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    keys = scratch.write(rows.select("doc_id", "tie"), "keys")
    parts = min(max(1, keys.count() // rows_a_part), 100_000)
    cut = []
    if parts > 1:
        cut = keys.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)
    limits = spark.sparkContext.broadcast(np.unique(np.array(cut, dtype=np.int64)))

    @F.pandas_udf("int")
    def part_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        at = np.searchsorted(limits.value, doc_id.where(known, -(1 << 62)).astype("int64"), side="right")
        return pd.Series(at.astype("int32"))

    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("least")
    firsts = sorted((r.part, r.least.doc_id, r.least.tie) for r in keys.withColumn("part", part_of("doc_id")).groupBy("part").agg(least).collect())
    parted = rows.select(part_of("doc_id").alias("part"), "doc_id", "text", "tie", F.lit(False).alias("guard"))
    if not firsts:
        return parted
    # Rows with the doc_id and tie of a range's first row are equal: one of them closes the range before.
    guards = spark.createDataFrame([(firsts[i - 1][0], d, t) for i, (_, d, t) in enumerate(firsts)], "part int, first long, first_tie long")
    same = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie"))
    closing = rows.join(F.broadcast(guards), same).groupBy("part", "doc_id", "tie").agg(F.first("text").alias("text"))
    return parted.union(closing.select("part", "doc_id", "text", "tie", F.lit(True)))


def _records(rows: Iterator[tuple[int | None, str, bool]]) -> Iterator[list]:
    """Fields of OUT for every row but guards; a row is complete once the fingerprint of the next one is known."""
    waiting = last = None
    for doc, text, guard in rows:
        if last is not None:
            was = last[1]
            with common.no_cycles():
                own, edited, changed = signature(was, text[: len(was) // 4])
            mine, other = digest(own), digest(edited)
            if waiting is not None:
                waiting[-1] = likeness(waiting[3], mine)
                yield waiting
            waiting = [last[0], len(was), hashlib.sha256(common.utf8(changed)).hexdigest(), mine, other, likeness(mine, other), 0.0]
            if guard:
                waiting[-1] = likeness(mine, digest(signature(text)[0]))
                yield waiting
                waiting = None
        last = None if guard else (doc, text)


def fingerprints(docs: DataFrame, rows_a_part: int = 2_000) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness; a row for each row of `docs`.

    The edited text has the last quarter of its code points replaced by the first as many of the next document's text,
    in ascending doc_id (nulls first, ties by a hash of the text); after the last comes the first, a lone row follows
    itself. A null text is an empty one. An empty text has no phrases: its likeness is 1 to another empty text and 0 to
    all others. Other columns are not read, and an empty table gives no rows. One text is parsed by one task, in memory
    of a few times its size.
    """
    ranges = in_order(docs, common.Scratch(docs.sparkSession, "fingerprints"), rows_a_part)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in common.rows(batches) for row in zip(part["doc_id"], part["text"], part["guard"], strict=True))
        found = _records(rows)
        while out := list(itertools.islice(found, 1000)):
            yield common.table(OUT, dict(zip(OUT.names, zip(*out, strict=True), strict=True)))

    sorted_ = ranges.repartition("part").sortWithinPartitions("part", "guard", F.asc_nulls_first("doc_id"), "tie")
    return sorted_.select("doc_id", "text", "guard").mapInArrow(parse, OUT_DDL)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.read(spark, sf_dir, "documents"))
