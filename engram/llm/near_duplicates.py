"""Near-duplicate groups by SetSketch registers (op6).

A document is the set of its word shingles. Documents of equal sets are one class from the start. Each class gets a
SetSketch: register r holds floor(1 - log_b(least value of hash function r over the set)), cut to 0..q+1, where values
are exponentially distributed. Registers of a union are the maxima of both, and two registers are equal with about the
sets' Jaccard similarity. Bands of five registers are hashed; 40 bands miss a pair of similarity 0.8 once in ten
million. A pair that shares a band is kept unless the likelihood of its joint register order at the threshold is far
below that at its best estimate, and then verified on both full sets.

Groups are never expanded into pairs. In each bucket members are compared with one pivot first, which joins a group of
copies along its pivots. Members of a bucket that are still in different components are then compared exactly, block by
block and not pair by pair, so that no link between two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common
from engram.llm.components import components

BANDS, WIDTH = 40, 5
REGISTERS = BANDS * WIDTH
#: Base of the register scale, rate of the exponential values, largest register.
B, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
_FACTOR = np.random.default_rng(20240913).integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BACK = _FACTOR[::-1].copy()
SKETCH = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sketch", pa.binary())])
#: A pair is dropped before verification if its log-likelihood at the threshold is this much below its best (5.6 sigma).
MARGIN = 16.0


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch of a set of 64-bit hashes, uint16."""
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), 256):
        x = low[i : i + 256, None] * _FACTOR
        x ^= x >> np.uint32(15)
        x += high[i : i + 256, None]
        x *= _BACK
        np.minimum(least, x.min(axis=0), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(B)), 0, TOP + 1).astype(np.uint16)


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sketches (rows of a and b) may reach the threshold, by maximum likelihood of the similarity.

    The numbers of registers that are larger in one, larger in the other and equal are multinomial; their
    probabilities follow from the similarity and the known set sizes.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        up, down = np.clip(p(u - v * j), 1e-9, 1), np.clip(p(v - u * j), 1e-9, 1)
        return more * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-9, 1))

    grid = np.stack([log_likelihood(np.minimum(j, most)) for j in np.linspace(0, 1, 51)])
    best = np.linspace(0, 1, 51)[grid.argmax(axis=0)]
    return (most >= threshold - 1e-9) & ((best >= threshold) | (log_likelihood(np.minimum(threshold, most)) >= grid.max(axis=0) - MARGIN))


def sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, counts = common.word_hashes([common.utf8(x) for x in texts])
    hashes, n = common.shingle_hashes(words, counts, size)
    return np.split(hashes, np.cumsum(n)[:-1])


def sketches(docs: DataFrame, size: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.rows(batches):
            found = sets(part["text"], size)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            regs = [registers(s).tobytes() if len(s) else b"" for s in found]
            yield common.table(SKETCH, {"doc_id": part["doc_id"], "tie": part["tie"], "n": [len(s) for s in found], "set_key": keys, "sketch": regs})

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return rows.mapInArrow(sketch, "doc_id long, tie long, n long, set_key binary, sketch binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(band long, nid long): 40 rows for each node."""
    schema = pa.schema([("band", pa.int64()), ("nid", pa.int64())])

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, BANDS, WIDTH).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), regs.shape[:2]) * np.uint64(0x2545F4914F6CDD1D)
                for k in range(WIDTH):
                    key = common.mix(key + regs[:, :, k])
                yield common.table(schema, {"band": key.view(np.int64).ravel(), "nid": np.repeat(batch.column("nid").to_numpy(), BANDS)})

    return nodes.select("nid", "sketch").mapInArrow(bands, "band long, nid long")


class Groups:
    """Working tables of one run: nodes, their buckets, verified links, components."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.docs, self.size, self.percent = docs, size, percent
        self.scratch = common.Scratch(docs.sparkSession, "near-duplicates")
        self.rows = self.scratch.write(sketches(docs, size), "rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie")).alias("rep")
        nodes = self.rows.where("n > 0").groupBy("set_key").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.nodes = self.scratch.write(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
        bands = band_keys(self.nodes)
        shared = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
        self.buckets = self.scratch.write(bands.join(shared, "band").select("band", "nid", "members"), "buckets")

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) whose sketches may reach the threshold."""
        threshold = self.percent / 100
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def likely_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                    ok = likely(x, y, batch.column("na").to_numpy().astype(float), batch.column("nb").to_numpy().astype(float), threshold)
                    yield common.table(schema, {c: batch.column(c).to_numpy()[ok] for c in ("a", "b")})

        a = self.nodes.select(F.col("nid").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
        b = self.nodes.select(F.col("nid").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(likely_ones, "a long, b long")

    def texts(self, wanted: DataFrame, name: str) -> DataFrame:
        """(nid, text) of the wanted nodes."""
        at = wanted.distinct().join(self.nodes.select("nid", F.col("rep.doc_id").alias("doc_id"), F.col("rep.tie").alias("tie")), "nid")
        text = self.docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
        found = text.join(at, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("tie"))).select("nid", "text")
        return self.scratch.write(found, name)

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Links among the pairs: those whose full shingle sets reach the threshold."""
        size, percent = self.size, self.percent
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        likely_pairs = self.scratch.write(self.candidates(pairs), f"{name}-likely")
        used = likely_pairs.select(F.col("a").alias("nid")).union(likely_pairs.select("b"))
        texts = self.texts(used, f"{name}-texts")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, own = None, None
            for part in common.rows(batches, 1 << 20):
                out = {"a": [], "b": []}
                for a, b, x, y in zip(part["a"], part["b"], sets(part["text"], size), part["text_a"], strict=True):
                    if a != last:
                        last, own = a, sets([y], size)[0]
                    both = np.intersect1d(own, x, assume_unique=True).size
                    if 100 * both >= percent * (len(own) + len(x) - both):
                        out["a"].append(a)
                        out["b"].append(b)
                yield common.table(schema, out)

        full = likely_pairs.join(texts.withColumnRenamed("nid", "b"), "b").join(texts.select(F.col("nid").alias("a"), F.col("text").alias("text_a")), "a")
        links = self.scratch.write(full.select("a", "b", "text", "text_a").mapInArrow(verify, "a long, b long").distinct(), name)
        self.scratch.drop(f"{name}-texts", f"{name}-likely")
        return links

    def open_buckets(self, labels: DataFrame) -> DataFrame:
        """(band, nid, label) of buckets whose members are in more than one component."""
        labelled = self.buckets.select("band", "nid").join(labels.withColumnRenamed("node", "nid"), "nid", "left")
        labelled = labelled.select("band", "nid", F.coalesce("label", "nid").alias("label"))
        mixed = labelled.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
        return labelled.join(mixed, "band")

    def labels(self) -> DataFrame:
        """(node, label) of all nodes with links; every link between two components has been looked for.

        A bucket's pivot is its member that shares buckets with most others: in a group of edited copies, the text that
        all of them are near to.
        """
        crowd = self.scratch.write(self.buckets.groupBy("nid").agg(F.sum("members").alias("crowd")), "crowd")
        ranked = self.buckets.join(crowd, "nid").select("band", "nid", F.struct("crowd", -F.col("nid")).alias("order"))
        pivots = ranked.groupBy("band").agg(F.max_by("nid", "order").alias("pivot"))
        votes = self.buckets.join(pivots, "band").where("nid <> pivot").groupBy(F.col("nid").alias("b"), F.col("pivot").alias("a")).agg(F.count("*").alias("k"))
        best = votes.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
        links = self.verified(best, "links-1")
        labels = components(links, self.scratch, "labels-1")
        return components(links.union(self.rest(labels)), self.scratch, "labels-2")

    def rest(self, labels: DataFrame) -> DataFrame:
        """All links between different components of nodes that meet in a bucket, without listing pairs.

        Open buckets that share members make one crowd. Linked sets differ in size by less than the threshold, so a crowd
        is parted by size: classes grow by 1 / threshold, and a node meets its own class and those beside it only. Of a
        class, the members of the crowd's largest component are on one side: of two nodes in different components at
        least one is outside it. Those outside are the asked ones, in blocks of about 500; every block meets every part
        (about 2,000 nodes) of a class in one task, which counts the shingles that each node shares with all of a block at
        once by an inverted index of the block. Nodes travel as their shingle hashes.
        """
        open_ = self.scratch.write(self.open_buckets(labels), "open")
        first = open_.groupBy("band").agg(F.min("nid").alias("a"))
        crowds = components(open_.join(first, "band").select("a", F.col("nid").alias("b")), self.scratch, "crowds")
        members = open_.select("nid", "label").distinct().join(crowds.select(F.col("node").alias("nid"), F.col("label").alias("crowd")), "nid")
        level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / self.percent)) + 1e-9)
        members = members.join(self.nodes.select("nid", level.alias("level")), "nid")
        members = self.scratch.write(members, "members")
        main = members.groupBy("crowd", "label").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        known = members.join(main, "crowd")
        near = F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level")
        asking = known.where("label <> main").select("crowd", near, "nid", "label")
        sizes = asking.groupBy("crowd", "level").agg(F.ceil(F.count("*") / 500).alias("blocks"))
        sizes = sizes.join(known.groupBy("crowd", "level").agg(F.ceil(F.count("*") / 2000).alias("parts")), ["crowd", "level"])
        pick = lambda seed, n: F.pmod(F.xxhash64("nid", F.lit(seed)), F.col(n))
        all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        task = ["crowd", "level", "block", "part"]
        asked = asking.join(sizes, ["crowd", "level"]).select("crowd", "level", pick(1, "blocks").alias("block"), all_of("parts").alias("part"), F.lit(0).alias("side"), "nid", "label")
        met = known.join(sizes, ["crowd", "level"]).select("crowd", "level", all_of("blocks").alias("block"), pick(2, "parts").alias("part"), F.lit(1).alias("side"), "nid", "label")
        size, percent = self.size, self.percent

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.rows(batches):
                found = [s.tobytes() for s in sets(part["text"], size)]
                yield pa.RecordBatch.from_arrays([pa.array(part["nid"], type=pa.int64()), pa.array(found, type=pa.binary())], names=["nid", "hashes"])

        held = self.texts(members.select("nid"), "rest-texts").mapInArrow(hashed, "nid long, hashes binary")
        rows = asked.union(met).join(self.scratch.write(held, "rest-sets"), "nid")
        self.scratch.drop("rest-texts")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, index, seen = None, [], None, set()
            for part in common.rows(batches, 1 << 20, "hashes"):
                out: dict[str, list] = {"a": [], "b": []}
                for *name, side, nid, label, packed in zip(*(part[c] for c in (*task, "side", "nid", "label", "hashes")), strict=True):
                    s = np.frombuffer(packed, dtype=np.uint64)
                    if name != now:
                        now, held, index, seen = name, [], None, set()
                    if side == 0:
                        held.append((nid, label, s))
                        continue
                    if not held:
                        continue
                    index = index or _Block(held)
                    for i in index.linked(s, percent):
                        other, its_label = held[i][:2]
                        if its_label != label and (i, label) not in seen:
                            seen.add((i, label))
                            out["a"].append(nid)
                            out["b"].append(other)
                yield common.table(schema, out)

        dealt = rows.repartition(*task).sortWithinPartitions(*task, "side").select(*task, "side", "nid", "label", "hashes")
        return self.scratch.write(dealt.mapInArrow(meet, "a long, b long"), "links-2")


class _Block:
    """Inverted index of a block of sets."""

    def __init__(self, held: list[tuple]):
        self.n = np.array([len(s) for *_, s in held], dtype=np.int64)
        flat = np.concatenate([s for *_, s in held])
        owner = np.repeat(np.arange(len(held)), self.n)
        order = np.argsort(flat, kind="stable")
        self.element, self.start = np.unique(flat[order], return_index=True)
        self.owner, self.start = owner[order], np.append(self.start, len(flat))

    def linked(self, s: np.ndarray, percent: int) -> list[int]:
        """Numbers of the sets of the block whose similarity to s reaches the threshold."""
        at = np.minimum(np.searchsorted(self.element, s), len(self.element) - 1)
        at = at[self.element[at] == s]
        n = self.start[at + 1] - self.start[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        both = np.bincount(self.owner[place], minlength=len(self.n))
        return np.flatnonzero(100 * both >= percent * (len(s) + self.n - both)).tolist()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and tie (xxhash64 of the text) for every row of `docs`.

    Words are runs of anything but ASCII white space, A-Z as a-z; a document's set is its distinct shingles of `size`
    words, one shingle if it has fewer. Documents are linked with 100 * intersection >= percent * union; component_id is
    the least doc_id reachable. A null or empty text has no shingles and no links and is its own component. Null
    doc_ids take part, but a component has one only if all are null. Equal rows are kept or dropped together. Other
    columns are not read, and an empty table gives no rows.
    """
    groups = Groups(docs, size, percent)
    nodes = groups.nodes.select("nid", "set_key", F.col("rep.doc_id").alias("first"))
    labels = groups.labels().withColumnRenamed("node", "nid")
    named = nodes.join(labels, "nid", "left").select("set_key", "first", F.coalesce("label", "nid").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    component = named.join(least, "label").select("set_key", "component_id")
    out = groups.rows.join(component, "set_key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "tie")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs`, all columns whatever their names: the one with the least doc_id of each group.

    Of equal rows of doc_id and text one stays. Texts without shingles (null and empty ones) stay, one of each doc_id. A
    null doc_id counts as the least one only if all of its group are null. An empty table gives no rows.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), size, percent).where("kept").select(_key(F.col("doc_id")).alias("key"), "tie")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tie"))
    return rows.join(kept, ["key", "tie"], "left_semi").dropDuplicates(["key", "tie"]).select("row.*")


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(-(1 << 63)))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by shingles of two words; see `near_duplicates` for nulls, empty texts and ties."""
    return near_duplicates(common.read(spark, sf_dir, "documents"), size=2).drop("tie")
