"""Benchmark decontamination: BM25 with block-max WAND, then a check of question and answer (op3).

Test items are the indexed side: an inverted index of their words, BM25 weights divided by the item's score for its own
text, so one threshold serves all items. Postings are kept in blocks of segments with the largest weight of a term in each
block. Every passage of the corpus (64 words, one begins every 32) is a query with a cursor in the postings of each of its
words. Cursors skip from block to block, past blocks whose maxima together stay below the threshold. In all other blocks
they are ordered by segment; the pivot is the first segment at which the maxima of the cursors up to it reach the
threshold, cursors before it skip to it, and it is scored. All items at or above the threshold are retrieved, none by rank. A retrieved item counts as leaked if
enough of the word n-grams of its question and of its answer stand in the text around the passage.

Statistics are those of all items. The index is broadcast in parts of bounded size, one at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common

K1, SATURATION_B = 1.2, 0.75
PASSAGE, STRIDE = 64, 32
BLOCK = 16
#: Passages that are searched side by side: at most so many rows of 64 cursors are in memory.
PASSAGES = 8_192
GRAM = 5
LEAK = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
)
LEAK_DDL = "doc_id long, item_id long, first_word long, score double, question_overlap double, answer_overlap double"
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def question_answer(text: str) -> tuple[str, str]:
    """The last sentences or lines that have five words are the answer, all before them the question; or both are all."""
    parts = [x for x in _SENTENCES.split(text.strip()) if any(c.isalnum() for c in x)]
    for k in range(len(parts) - 1, 0, -1):
        question, answer = " ".join(parts[:k]), " ".join(parts[k:])
        if len(words(answer)) >= GRAM and len(words(question)) >= GRAM:
            return question, answer
    return text, text


def words(text: str | None) -> np.ndarray:
    return common.word_hashes([common.utf8(text)], common.NO_WORD)[0]


def grams(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Distinct word n-grams, one of all words if there are fewer."""
    return common.shingle_hashes(hashes, np.array([len(hashes)]), size)[0]


@dataclass
class Index:
    """Terms in hash order; postings of term t at start[t]:start[t+1], block maxima at block_start[t]:block_start[t+1]."""

    term: np.ndarray
    start: np.ndarray
    segment: np.ndarray
    weight: np.ndarray
    most: np.ndarray
    block_start: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    item_of: np.ndarray
    items: list[tuple[int, int, list[np.ndarray], int]]

    @property
    def blocks(self) -> int:
        return -(-len(self.item_of) // BLOCK)


def segments_of(text: str) -> list[np.ndarray]:
    """An item's words in segments of at most a passage's length."""
    hashes = words(text)
    return [x for x in np.array_split(hashes, max(1, -(-len(hashes) // PASSAGE))) if len(x)]


def build(items: list[tuple[int, str]], df: dict[int, int], number: int, mean: float) -> Index:
    """Index of (item_id, text). df, number, mean: segments with a term, segments, and their mean length, of all items."""
    item_of, parts, tf = [], [], []
    for n, (item, text) in enumerate(items):
        hashes = words(text)
        question, answer = question_answer(text)
        size = max(1, min(GRAM, len(hashes)))
        parts.append((item, size, [grams(words(x), size) for x in (question, answer)], len(hashes)))
        for piece in segments_of(text):
            tf.append(np.unique(piece, return_counts=True))
            item_of.append(n)
    rows = []
    for n, (t, c) in enumerate(tf):
        idf = np.array([math.log(1 + (number - df[x] + 0.5) / (df[x] + 0.5)) for x in t.tolist()])
        w = idf * c * (K1 + 1) / (c + K1 * (1 - SATURATION_B + SATURATION_B * c.sum() / mean))
        rows += zip(t.tolist(), [n] * len(t), (w / w.sum()).tolist(), strict=True)
    rows.sort()
    t = np.array([r[0] for r in rows], dtype=np.uint64)
    segment, weight = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows])
    term, start = np.unique(t, return_index=True)
    most = np.maximum.reduceat(weight, start) if len(start) else weight
    start = np.append(start, len(t))
    of_term = np.repeat(np.arange(len(term)), np.diff(start))
    blocks = len(tf) // BLOCK + 1
    block_key, first = np.unique(of_term * blocks + segment // BLOCK, return_index=True)
    block_max = np.maximum.reduceat(weight, first) if len(first) else weight
    block_start = np.searchsorted(block_key // blocks, np.arange(len(term) + 1))
    return Index(term, start, segment, weight, most, block_start, block_key % blocks, block_max, np.array(item_of, dtype=np.int64), parts)


class Searcher:
    """Block-max WAND for many passages at once: each step moves every passage that is still searching by one pivot."""

    def __init__(self, index: Index, threshold: float):
        self.index, self.threshold = index, threshold
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(index.term & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        n = len(index.term)
        self.end = len(index.item_of)
        # Postings in one ascending list, so that any cursor's next place is one binary search. The term after all others
        # has no postings.
        of_term = np.repeat(np.arange(n), np.diff(index.start))
        self.posting = of_term * (self.end + 1) + index.segment
        self.segment, self.weight = np.append(index.segment, self.end), np.append(index.weight, 0.0)
        self.most = np.append(index.most, 0.0)
        self.stop = np.append(index.start[1:], len(index.segment))
        # The blocks of each term are closed by one that lies behind all others.
        close = np.arange(n + 1)
        self.block = np.insert(index.block, np.append(index.block_start[1:], len(index.block)), index.blocks).astype(np.int32)
        self.block_max = np.insert(index.block_max, np.append(index.block_start[1:], len(index.block)), 0.0)
        self.first_block = np.append(index.block_start[:-1], len(index.block)) + close

    def terms(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the hashes, term) of those that are in the index."""
        at = np.flatnonzero(self.filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(self.index.term):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.index.term, hashes[at]), len(self.index.term) - 1)
        ok = self.index.term[found] == hashes[at]
        return at[ok], found[ok]

    def passages(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, a row of its distinct terms) of passages whose largest weights together reach the threshold."""
        none = len(self.index.term)
        begin = np.cumsum(counts) - counts
        at, term = self.terms(hashes)
        text = np.searchsorted(np.cumsum(counts), at, side="right")
        step = (at - begin[text]) // STRIDE
        most = int(counts.max(initial=0)) // STRIDE + 2
        # A word is in the passage that begins in its own stride and in the one before.
        passage = np.concatenate((text * most + step, (text * most + step - 1)[step > 0]))
        key = np.sort(passage * max(none, 1) + np.concatenate((term, term[step > 0])))
        key = key[np.diff(key, prepend=-1) > 0]
        passage, term = key // max(none, 1), key % max(none, 1)
        new = np.flatnonzero(np.diff(passage, prepend=-1))
        names, n = passage[new], np.diff(np.append(new, len(passage)))
        p = np.repeat(np.arange(len(names)), n)
        able = np.bincount(p, weights=self.most[term], minlength=len(names)) >= self.threshold - 1e-9
        keep = able[p]
        number = np.cumsum(able) - 1
        row = number[p[keep]]
        n = n[able]
        out = np.full((len(n), int(n.max(initial=0))), none, dtype=np.int64)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = term[keep]
        return names[able] // most, names[able] % most * STRIDE, out

    def seek(self, term: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after a segment, or its end."""
        return np.searchsorted(self.posting, term * (self.end + 1) + segment)

    def retrieve(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in the text, segment, score) of all passages and segments at or above the threshold."""
        text, first, term = self.passages(hashes, counts)
        out = []
        least = self.threshold - 1e-9
        for a in range(0, len(text), PASSAGES):
            out += self._search(np.arange(a, min(a + PASSAGES, len(text))), term[a : a + PASSAGES], least)
        who, segment, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        hit = score >= self.threshold
        who = who[hit]
        return text[who], first[who], segment[hit], score[hit]

    def _search(self, who: np.ndarray, term: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Cursors go from block to block; only blocks whose maxima together reach the threshold are entered."""
        found = []
        at = self.first_block[term]
        while len(who):
            block = self.block[at]
            nearest = block.min(axis=1)
            here = block == nearest[:, None]
            maximum = self.block_max[at] * here
            able = np.flatnonzero(maximum.sum(axis=1) >= least)
            if len(able):
                found += self._pivots(who[able], term[able], maximum[able], nearest[able].astype(np.int64), least)
            at += here
            open_ = nearest < self.index.blocks
            if not open_.all():
                who, term, at = who[open_], term[open_], at[open_]
        return found

    def _pivots(self, who: np.ndarray, term: np.ndarray, bound: np.ndarray, block: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """WAND within one block of each passage; bound: the block's maxima of its terms, 0 for those that are not in it.

        The pivot is the first segment up to which the bounds of the cursors reach the threshold. Cursors before it skip
        to it, then it is scored, and its cursors move on.
        """
        found = []
        end = (block + 1) * BLOCK
        doc = np.where(bound > 0, self._segment(term, self.seek(term, (block * BLOCK)[:, None])), self.end)
        while len(who):
            doc = np.where(doc < end[:, None], doc, self.end)
            ranked = np.sort((doc << 6) + np.arange(doc.shape[1]), axis=1)  # a passage has at most 64 terms
            order = (ranked & 63) + np.arange(len(doc))[:, None] * doc.shape[1]
            ranked >>= 6
            total = np.cumsum(bound.ravel()[order] * (ranked < self.end), axis=1)
            reached = total[:, -1] >= least
            if not reached.all():
                who, term, bound, end, doc, ranked, total = (x[reached] for x in (who, term, bound, end, doc, ranked, total))
                if not len(who):
                    break
            pivot = ranked[np.arange(len(who)), (total >= least).argmax(axis=1)]
            row, col = np.nonzero(doc <= pivot[:, None])
            t = term[row, col]
            to = self.seek(t, pivot[row])
            hit = self._segment(t, to) == pivot[row]
            score = np.bincount(row[hit], weights=self.weight[to[hit]], minlength=len(who))
            full = np.flatnonzero(score >= least)
            found.append((who[full], pivot[full], score[full]))
            doc[row, col] = self._segment(t, to + hit)
        return found

    def _segment(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.where(place < self.stop[term], self.segment[np.minimum(place, len(self.segment) - 1)], self.end)


def _indexes(docs: DataFrame, benchmark: DataFrame, items_a_part: int, part_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of the benchmark's hash parts, one at a time; statistics are those of all items.

    A part holds about `items_a_part` items and `part_bytes` bytes of text, or one item.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "decontamination")
    items = scratch.write(benchmark.select("item_id", "text").where("text is not null").distinct(), "items")
    schema = pa.schema([("part", pa.int64()), ("term", pa.int64()), ("df", pa.int64()), ("length", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.rows(batches, 1 << 18):
            out: dict[str, list] = {f.name: [] for f in schema}
            for part, text in zip(rows["part"], rows["text"], strict=True):
                for piece in segments_of(text):
                    terms = np.unique(piece).view(np.int64).tolist()
                    out["part"] += [part] * (len(terms) + 1)
                    out["term"] += [None, *terms]
                    out["df"] += [1] * (len(terms) + 1)
                    out["length"] += [len(piece)] + [0] * len(terms)
            yield common.table(schema, out)

    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size.n // items_a_part), -(-size.bytes // part_bytes))
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    counted = items.select(part.alias("part"), "text").mapInArrow(count, "part long, term long, df long, length long")
    counted = scratch.write(counted.groupBy("part", "term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")), "counts")
    whole = counted.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    terms = scratch.write(counted.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")), "terms")
    for k in range(parts):
        mine = [(r.item_id, r.text) for r in items.where(part == k).orderBy("item_id", "text").collect()]
        known = terms.join(counted.where((F.col("part") == k) & F.col("term").isNotNull()).select("term"), "term", "left_semi").collect()
        df = {r.term & ((1 << 64) - 1): r.df for r in known}
        yield spark.sparkContext.broadcast(build(mine, df, whole.n, whole.length / max(whole.n, 1)))


def matches(searcher: Searcher, texts: list[str | None], overlap: float) -> list[tuple]:
    """(text number, item_id, first word, score, question and answer overlap) of leaks, each pair at its best passage."""
    index = searcher.index
    hashes, counts = common.word_hashes([common.utf8(x) for x in texts], common.NO_WORD)
    begin = np.cumsum(counts) - counts
    hits: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for text, first, segment, score in zip(*(x.tolist() for x in searcher.retrieve(hashes, counts)), strict=True):
        hits.setdefault((text, int(index.item_of[segment])), []).append((first, score))
    best: dict[tuple[int, int], tuple] = {}
    for (text, n), found in hits.items():
        item, size, sides, length = index.items[n]
        around = max(2 * PASSAGE, length)
        for stretch in _stretches(sorted(found), around if length > 2 * PASSAGE else 0):
            a = begin[text] + max(0, stretch[0][0] - around)
            near = grams(hashes[a : min(begin[text] + counts[text], begin[text] + stretch[-1][0] + PASSAGE + around)], size)
            q, r = (float(np.isin(x, near).mean()) for x in sides)
            if q >= overlap and r >= overlap:
                score, first = max((score, -first) for first, score in stretch)
                row = (min(q, r), score, first, q, r, item)
                if (text, n) not in best or row[:5] > best[text, n][:5]:
                    best[text, n] = row
    return [(t, x[5], -x[2], x[1], x[3], x[4]) for (t, _), x in sorted(best.items())]


def _stretches(hits: list[tuple[int, float]], apart: int) -> Iterator[list[tuple[int, float]]]:
    """Runs of (first word, score) that begin at most `apart` words after the one before; each alone if `apart` is 0."""
    run: list[tuple[int, float]] = []
    for hit in hits:
        if run and hit[0] - run[-1][0] > (apart or -1):
            yield run
            run = []
        run.append(hit)
    yield run


def leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, overlap: float = 0.6, items_a_part: int = 2_048, part_bytes: int = 8 << 20
) -> DataFrame:
    """One row for each (doc_id, item_id) leak, at its best passage: first_word, score, and both overlaps.

    A text leaks an item if a passage of it scores `threshold` or more of the item's own score, and at least `overlap`
    of the 5-grams of the item's question and of its answer stand within 128 words around. Passages of an item of more
    words are taken together where they are no further apart than its length, and its 5-grams count within its length
    around them, so an item is found at any length. Words are runs of letters and
    digits, A-Z as a-z. Null or empty texts and items match nothing; equal rows give equal rows, a null doc_id or
    item_id stays null, other columns are not read, and empty tables give no rows. Every passage of every text is a
    query, however long the text. Each part of the benchmark is one pass, and its index goes before the next is made;
    parts change no score.
    """
    scratch, done = common.Scratch(docs.sparkSession, "leaks"), None
    held = None
    for k, index in enumerate(_indexes(docs, benchmark, items_a_part, part_bytes)):
        if held is not None:
            written = scratch.write(_search(docs, held, threshold, overlap), f"part-{k}")
            done = written if done is None else done.union(written)
            held.destroy()
        held = index
    last = _search(docs, held, threshold, overlap)
    return last if done is None else done.union(last)


def _search(docs: DataFrame, held: Broadcast, threshold: float, overlap: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(held.value, threshold)
        for part in common.rows(batches):
            found = matches(searcher, part["text"], overlap)
            ids = [part["doc_id"][m[0]] for m in found]
            columns = [ids, *zip(*(m[1:] for m in found), strict=True)] if found else [[]] * len(LEAK)
            yield common.table(LEAK, dict(zip(LEAK.names, columns, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(search, LEAK_DDL)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.4, overlap: float = 0.6, items_a_part: int = 2_048, part_bytes: int = 8 << 20
) -> DataFrame:
    """Rows of `docs`, all columns whatever their names, whose text leaks no item; see `leaks`.

    Null and empty texts stay, repeated rows stay or go together, and an empty table gives none. With several parts each
    is a pass over what the one before has kept.
    """
    scratch = common.Scratch(docs.sparkSession, "leaks")
    held = None
    for k, index in enumerate(_indexes(docs, benchmark, items_a_part, part_bytes)):
        if held is not None:
            docs = scratch.write(_clean(docs, held, threshold, overlap), f"kept-{k}")
            held.destroy()
        held = index
    return _clean(docs, held, threshold, overlap)


def _clean(docs: DataFrame, held: Broadcast, threshold: float, overlap: float) -> DataFrame:
    def clean(texts: list[str | None]) -> list[bool]:
        bad = {m[0] for m in matches(Searcher(held.value, threshold), texts, overlap)}
        return [i not in bad for i in range(len(texts))]

    return common.keep_rows(docs, clean)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items in documents; see `leaks`."""
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
