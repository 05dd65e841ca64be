"""Collocations by Toivonen's sampling: exact counts of frequent phrases and of their negative border (op12).

Phrases of one to four words are mined by language. A sample of the documents, with a lowered threshold, proposes the set S
of phrases that may be frequent. A full pass counts, exactly, S and its negative border: every phrase whose first and last
parts (all words but one) are both in S; single words have no parts and all count. Phrases of S are counted by themselves,
those of the border by hash, so that no frequent one is missed. If one of the border proves frequent, phrases that contain
it may be frequent and uncounted: it joins S, and a further full pass counts it and all that grows out of it. With none
left, all frequent phrases have been counted.

Tasks hold S as a filter of hashes of a fixed size that is built by segments and broadcast. It never misses a phrase; a
phrase that it holds by mistake only lets more phrases be counted, so results are exact whatever the size of S.
Within a task, words and phrases are numbered densely, without hashes; shuffles carry partial counts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm import common

#: Bytes that end a piece, and those that part words.
ENDS = np.zeros(256, dtype=bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
PARTS = ENDS.copy()
PARTS[list(b" \t")] = True

COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
COUNTS_DDL = "lang string, phrase string, h long, n long"


#: A filter's segments: the high bits of a hash choose one, and three times 15 of its low bits a place in it.
SEGMENT = 4096


def _segments(h: np.ndarray, size: int) -> np.ndarray:
    """Segment of each hash in a filter of `size` bytes, a power of two."""
    bits = (size // SEGMENT).bit_length() - 1
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)


def _places(h: np.ndarray) -> Iterator[np.ndarray]:
    for shift in (0, 15, 30):
        yield (h >> np.uint64(shift) & np.uint64(0x7FFF)).astype(np.int64)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter holds; never False for one that was put in."""
    base, found = _segments(h, len(bits)) * SEGMENT, np.ones(len(h), dtype=bool)
    for place in _places(h):
        found &= (bits[base + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return found


def filter_of(hashes: DataFrame, size: int, base: np.ndarray | None = None) -> np.ndarray:
    """Bits of a filter of `size` bytes (a power of two, 4 kB at least) that holds the column h, and all that `base` holds.

    Hashes are dealt out by segment; a task sets the bits of its segments, and the driver gets each segment once.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            segment = _segments(h, size)
            order = np.argsort(segment, kind="stable")
            h, segment = h[order], segment[order]
            for some in np.split(np.arange(len(h)), np.flatnonzero(np.diff(segment)) + 1):
                if len(some):
                    mine = held.setdefault(int(segment[some[0]]), np.zeros(SEGMENT, dtype=np.uint8))
                    for place in _places(h[some]):
                        np.bitwise_or.at(mine, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.int32()), pa.array([x.tobytes() for x in held.values()], type=pa.binary())], names=["segment", "bits"])

    bits = np.zeros(size, dtype=np.uint8) if base is None else base.copy()
    if size > SEGMENT:
        hashes = hashes.select("h").repartition(F.shiftrightunsigned("h", 65 - (size // SEGMENT).bit_length()))
    for row in hashes.select("h").mapInArrow(build, "segment int, bits binary").collect():
        at = row.segment * SEGMENT
        bits[at : at + SEGMENT] |= np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order of their first places, number of each place's key)."""
    coded = pa.array(key).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _word_values(words: pa.Array) -> np.ndarray:
    """64-bit hash of each of some words, none of which is empty."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    if len(offsets) < 2:
        return np.empty(0, dtype=np.uint64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    start, length = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(start, length)
    value = common.BYTE_CODE[data] * common.powers(int(length.max()))[place]
    return common.mix(np.add.reduceat(value, start) + length.astype(np.uint64))


class Words:
    """The words of some texts: dense (language, word) numbers, and which words follow each other within a piece."""

    def __init__(self, texts: list[str | None], langs: list[str | None]):
        encoded = [*map(common.utf8, texts)]
        data = np.frombuffer(b"\n".join([*encoded, b""]).translate(common.LOWER), dtype=np.uint8)
        stops = np.cumsum(np.array([len(x) + 1 for x in encoded], dtype=np.int64))
        del encoded
        inside = ~PARTS[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        begin, length = edge[::2], edge[1::2] - edge[::2]
        piece = np.searchsorted(np.flatnonzero(ENDS[data]), begin)
        self.joined = piece[1:] == piece[:-1]
        lang = pa.array(["und" if x is None else x for x in langs], type=pa.string()).dictionary_encode()
        offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        n = max(len(coded.dictionary), 1)
        owner = np.searchsorted(stops, begin, side="right")
        found, self.at = _numbered(lang.indices.to_numpy()[owner].astype(np.int64) * n + coded.indices.to_numpy())
        self.counts = np.bincount(self.at, minlength=len(found))
        of, word = found // n, found % n
        self.langs, self.lang = lang.dictionary, lang.dictionary.take(pa.array(of))
        self.lang_counts = np.bincount(of, weights=self.counts, minlength=len(self.langs)).astype(np.int64)
        self.words = coded.dictionary.take(pa.array(word)).cast(pa.binary())
        self.value = _word_values(coded.dictionary)[word]
        tags = [int.from_bytes(hashlib.blake2b(common.utf8(x), digest_size=8).digest()) for x in self.langs.to_pylist()]
        self.tag = np.array(tags, dtype=np.uint64)[of]


def phrases(words: Words, most: int, old: np.ndarray | None, new: np.ndarray | None) -> Iterator[tuple[pa.Array | None, pa.Array | None, np.ndarray, np.ndarray]]:
    """(language, phrase, hash, number) of distinct phrases to count in some texts; the border comes as hashes alone.

    Without filters all phrases of up to `most` words, by hash. With `new`: what it holds and whose parts it holds, by
    phrase, and what only its parts are held of, by hash. With `old` too, only what that pass has not counted so before,
    and its border then goes all the way: whatever grows out of a new phrase counts at once, not a word a pass.
    """
    value, lang, text, counts = words.value * common.BASE + words.tag, words.lang, words.words, words.counts
    at = words.at.astype(np.int64)  # number of the phrase that begins at each word; -1: none
    known = np.full(len(value), old is not None)  # both parts are held by `old`
    singles = len(value)
    for k in range(1, most + 1):
        h = common.mix(value + np.uint64(k))
        if new is None:
            yield None, None, h, counts
            grows = knew = np.ones(len(h), dtype=bool)
        else:
            grows = has(new, h)
            knew = known & has(old, h) if old is not None else known
            exact, border = grows & ~knew, ~grows & ~known
            if old is not None:
                grows = grows | ~known
            yield lang.filter(pa.array(exact)), text.filter(pa.array(exact)), h[exact], counts[exact]
            yield None, None, h[border], counts[border]
        first, last = at[:-1], at[1:]
        where = np.flatnonzero(words.joined & (first >= 0) & (last >= 0))
        where = where[grows[first[where]] & grows[last[where]]]
        if k == most or not len(where):
            return
        key, back = _numbered(first[where] * singles + words.at[where + k])
        counts = np.bincount(back, minlength=len(key))
        one = np.empty(len(key), dtype=np.int64)
        one[back] = where
        prefix, tail = key // singles, key % singles
        known = knew[prefix] & knew[last[one]]
        value = value[prefix] * common.BASE + words.value[tail]
        if new is not None:
            lang = lang.take(pa.array(prefix))
            text = pc.binary_join_element_wise(text.take(pa.array(prefix)), words.words.take(pa.array(tail)), b" ")
        at = np.full(len(at), -1, dtype=np.int64)
        at[where] = back


def count_phrases(docs: DataFrame, most: int, old: Broadcast | None = None, new: Broadcast | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """Partial counts (lang, phrase, h, n) of what `phrases` names; of a border phrase the hash only.

    The first pass with a filter adds a row with an empty phrase for each language and some texts: the number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, now = (None if x is None else x.value for x in (old, new))
        for part in common.rows(batches, slice_bytes):
            words = Words(part["text"], part["lang"])
            if new is not None and old is None:
                size = len(words.langs)
                yield pa.RecordBatch.from_arrays([words.langs, pa.array([""] * size, type=pa.string()), pa.array(np.zeros(size, dtype=np.int64)), pa.array(words.lang_counts)], schema=COUNTS)
            for lang, text, h, n in phrases(words, most, before, now):
                for start in range(0, len(h), 1 << 16):
                    some = slice(start, start + (1 << 16))
                    size = len(h[some])
                    none = pa.nulls(size, pa.string())
                    shown = [none, none] if text is None else [lang[some], text[some].cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*shown, pa.array(h[some].view(np.int64)), pa.array(n[some].astype(np.int64))], schema=COUNTS)

    return docs.select("text", "lang").mapInArrow(run, COUNTS_DDL)


def frequent_phrases(docs: DataFrame, support: int = 30, most: int = 4, fraction: float = 0.25, slack: float = 0.4, filter_bytes: int = 64 << 20) -> DataFrame:
    """All phrases of up to `most` words with `support` occurrences or more in their language: lang, words, phrase, n.

    Rows of no words hold the number of words of each language. `fraction` of the documents proposes phrases with `slack`
    times as many occurrences as `support` would be in it; a filter has 16 bits for each of them, and `filter_bytes` (a
    power of two) at most. All three change the number of passes and their work, not the result.

    The border is counted by 64-bit hashes, which bounds each phrase from above: where a hash has `support` occurrences
    it joins S, and the next pass counts the phrases that have it exactly.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "collocations")
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1000)) < int(fraction * 1000))
    least = max(1, int(slack * fraction * support))
    proposed = scratch.write(count_phrases(sample, most).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "proposed")
    size, want = SEGMENT, min(filter_bytes, 2 * proposed.count())
    while size < want:
        size *= 2
    bits, passes = filter_of(proposed, size), []
    scratch.drop("proposed")
    old, new = None, spark.sparkContext.broadcast(bits)
    for k in itertools.count():
        counted = count_phrases(docs, most, old, new).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
        passes.append(scratch.write(counted.where((F.col("n") >= support) | (F.col("phrase") == "")), f"pass-{k}"))
        failed = passes[-1].where("phrase IS NULL").select("h")
        if old is not None:
            old.destroy()
        if failed.isEmpty():
            new.destroy()
            break
        bits = filter_of(failed, size, bits)
        old, new = new, spark.sparkContext.broadcast(bits)
    found = passes[0]
    for more in passes[1:]:
        found = found.union(more)
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    # A phrase that a filter holds by mistake may be counted twice, to the same number.
    once = found.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("n").alias("n"))
    return once.select("lang", words.alias("words"), "phrase", "n")


def collocations(docs: DataFrame, support: int = 30, most: int = 4, top: int = 2000, percent: int = 80, parts: int = 64, **mining) -> DataFrame:
    """Each language's first `top` phrases of 2 to `most` words: lang, rank, phrase, a, l, r, n, score.

    a: occurrences, at least `support`. Cut after its first k words a phrase gives l and r, those of its two parts, and
    floor(2000000 a / (l + r)); the cut with the least score counts, the smallest k of equals. A phrase goes if a longer
    candidate holds it and has `percent` of its occurrences. Order: score, a (descending), phrase (UTF-8 bytes).

    A null lang is `und`; null and empty texts hold no words; repeated rows count each; doc_id only deals out the sample;
    other columns are not read; an empty table gives no rows. Numbers are decimals where products may pass 64 bits.
    """
    held = common.Scratch(docs.sparkSession, "phrases").write(frequent_phrases(docs, support, most, **mining), "frequent")
    all_words = held.where("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    found = held.where("words > 0")
    candidates = found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    # Longer candidates: the most occurrences of one that holds a phrase.
    inner = F.expr("filter(flatten(transform(sequence(1, words), i -> transform(sequence(2, words), k -> if(k < words and i + k - 1 <= words, array_join(slice(w, i, k), ' '), null)))), x -> x is not null)")
    longer = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most").cast("decimal(19,0)") < percent * F.col("a").cast("decimal(19,0)"))).drop("most")
    cut = kept.select("lang", "phrase", "a", "words", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"))
    counts = found.select("lang", "phrase", "n")
    for side in ("left", "right"):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(f"{side}_n")), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("score", F.call_function("div", F.lit(2000000).cast("decimal(10,0)") * wide("a"), wide("left_n") + wide("right_n")))
    least = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", F.col("left_n").alias("l"), F.col("right_n").alias("r"))).alias("x"))
    rows = least.select("lang", "phrase", "a", "x.score", "x.l", "x.r").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(all_words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`: phrases of 2 to 4 words with 30 occurrences or more, 2,000 a language. Nulls and repeats as in `collocations`."""
    return collocations(common.read(spark, sf_dir, "documents"))


#: All phrases counted, without mining.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM x, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30), total AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS MATERIALIZED (SELECT DISTINCT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, n FROM c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS j) WHERE j < k AND i + j - 1 <= k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.n::HUGEINT >= 80 * c.n::HUGEINT)),
part AS MATERIALIZED (SELECT lang, phrase, n, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:k], ' ') AS tail FROM kept, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
cut AS (SELECT part.lang, part.phrase, part.n AS a, j, a.n AS l, b.n AS r, (2000000 * part.n::HUGEINT) // (a.n + b.n) AS score
  FROM part JOIN f a ON a.lang = part.lang AND a.phrase = head JOIN f b ON b.lang = part.lang AND b.phrase = tail),
m AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT m.lang, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n AS n, score::BIGINT AS score
FROM m JOIN total ON total.lang = m.lang QUALIFY rank <= 2000
"""
