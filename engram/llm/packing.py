"""Best-fit packing of token sequences by exact complements (op8).

Only the histogram of piece lengths, at most `limit` counts, reaches the driver. There an index lists single lengths,
pairs and triples by their sum. Each length, longest first, looks up the combinations that fill its gap exactly and takes
as many sequences as the counts of free pieces allow; what has no exact complement is filled best-fit. The result is a list of slots: "the pieces
of length L with ranks r .. r+k-1 go to sequences s .. s+k-1 at offset o". Pieces find theirs by rank, so the work of
placing rows is a lookup and the only shuffle carries piece counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common, tokens

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int32()), ("local", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, local long"


class SumIndex:
    """Combinations of one, two and three lengths by their sum, larger lengths first.

    The combinations of a sum are listed when it is asked for, from the lengths that occur at all. Counts of free pieces
    only fall, so a combination that is short of a length stays so: each list has a mark up to which all are spent, which
    only moves forward. The `most` lists asked for last are in memory, some 100 MB at a limit of 1,024; others are listed
    again when they are needed, and keep their marks.
    """

    def __init__(self, free: np.ndarray, most: int = 200):
        self.free, self.occurs, self.most = free, free > 0, most
        self.lists: dict[int, list[np.ndarray]] = {}
        self.marks: dict[int, list[int]] = {}

    def _add(self, total: int) -> None:
        one = np.array([[total]])
        a = np.arange(total - 1, (total - 1) // 2, -1)
        two = np.stack((a, total - a), axis=1)
        a = np.arange(total - 2, (total - 1) // 3, -1)
        low, high = (total - a + 1) // 2, np.minimum(a, total - a - 1)
        n = np.maximum(high - low + 1, 0)
        first = np.repeat(a, n)
        second = np.repeat(high, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        three = np.stack((first, second, total - first - second), axis=1)
        self.lists[total] = [x[self.occurs[x].all(axis=1)].astype(np.uint16) for x in (one, two, three)]
        self.marks.setdefault(total, [0, 0, 0])
        if len(self.lists) > self.most:
            del self.lists[next(iter(self.lists))]

    @staticmethod
    def _enough(rows: np.ndarray, free: np.ndarray) -> np.ndarray:
        ok = free[rows[:, 0]] > 0
        if rows.shape[1] > 1:
            ok &= free[rows[:, 1]] > (rows[:, 1] == rows[:, 0])
        if rows.shape[1] > 2:
            ok &= free[rows[:, 2]] > (rows[:, 2] == rows[:, 1]).astype(int) + (rows[:, 2] == rows[:, 0])
        return ok

    def find(self, total: int, taken: list[int], step: int = 512) -> list[int] | None:
        """One, two or three free lengths with this sum, beside the taken ones."""
        if total in self.lists:
            self.lists[total] = self.lists.pop(total)  # asked for last
        else:
            self._add(total)
        left = self.free
        if taken:
            left = left.copy()
            np.subtract.at(left, taken, 1)
        for parts, rows in enumerate(self.lists[total]):
            moving = True
            at = self.marks[total][parts]
            while at < len(rows):
                some = rows[at : at + step]
                if moving:
                    alive = np.flatnonzero(self._enough(some, self.free))
                    moving = not len(alive)
                    self.marks[total][parts] = at + (len(some) if moving else int(alive[0]))
                hit = np.flatnonzero(self._enough(some, left))
                if len(hit):
                    return some[hit[0]].tolist()
                at += step
        return None


def plan(counts: dict[int, int], limit: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, number, first sequence, offset) that hold all pieces, and the number of sequences."""
    free = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        free[length] = n
    used = np.zeros(limit + 1, dtype=np.int64)
    index = SumIndex(free)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def consume(pattern: list[int]) -> None:
        nonlocal sequences
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        n = min(int(free[x]) // k for x, k in need.items())
        offset = 0
        for x in pattern:
            slots.append((x, int(used[x]), n, sequences, offset))
            used[x] += n
            free[x] -= n
            offset += x
        sequences += n

    for length in range(limit, 0, -1):
        while free[length] > 0:
            pattern, gap = [length], limit - length
            while gap > 0:
                if (rest := index.find(gap, pattern)) is not None:
                    pattern += rest
                    break
                left = free[: gap + 1].copy()
                np.subtract.at(left, [x for x in pattern if x <= gap], 1)
                fit = np.flatnonzero(left > 0)
                if not len(fit):
                    break
                pattern.append(int(fit[-1]))
                gap -= pattern[-1]
            consume(pattern)
    return slots, sequences


def token_pieces(docs: DataFrame, path: str, limit: int, end_id: int, cache_size: int = 1_200_000) -> DataFrame:
    """A row for each piece of each text, with its partition and its rank among that partition's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.worker_cache(path, tokens.packed, cache_size)
        get, last, pid = cache.__getitem__, tokens.pack_ids([end_id]), TaskContext.get().partitionId()
        seen = [0] * (limit + 1)
        for part in common.rows(batches):
            out = {f.name: [] for f in PIECES}
            for doc, keys in zip(part["doc_id"], cache.prepare(part["text"]), strict=True):
                ids = b"".join(map(get, keys)) + last
                n = len(ids) // 4
                at = 0
                for piece in range(-(-n // limit)):
                    stop = at + ((n % limit or limit) if piece == 0 else limit)
                    size = stop - at
                    for name, x in zip(out, (doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * stop]), pid, seen[size]), strict=True):
                        out[name].append(x)
                    seen[size] += 1
                    at = stop
            yield common.table(PIECES, out)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES_DDL)


def pack(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 1024, end_id: int = 2) -> DataFrame:
    """Packs all texts into sequences of at most `limit` tokens: a row for each piece.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id alone, in one
    piece. Repeated rows are packed each for itself, a null doc_id stays null, other columns are not read, and an
    empty table gives no rows. Longer texts are cut into pieces of `limit`, the first of which may be shorter.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "packing")
    parts = scratch.write(token_pieces(docs, tokenizer_path or tokens.default_path(), limit, end_id), "pieces")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan(counts, limit)
    slots.sort()
    held = spark.sparkContext.broadcast(np.array(slots, dtype=np.int64).reshape(-1, 5))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = held.value
        # Ranks of a length begin at length * 2**44 in one ascending list.
        first = slot[:, 0] * (1 << 44) + slot[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(first, length * (1 << 44) + rank, side="right") - 1
            sequence = slot[at, 3] + rank - slot[at, 1]
            kept = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    base = common.partition_offsets(parts, ["length"])
    ranked = parts.join(base, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
