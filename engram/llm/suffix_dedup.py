"""Removal of byte strings that repeat anywhere in a corpus, by a collection Burrows-Wheeler transform (op1).

Equal windows of `length` bytes have equal least 32-grams at the same offset. So each window belongs to one anchor, the
leftmost least 32-gram in it, and a run of windows with the same anchor is an item: some 90 windows, 290 bytes. Equal
windows are in items of the same anchor, so anchors partition the work exactly:

1. Items whose anchor occurs once have no repeated window and go, on hashes alone; most of a corpus does.
2. Each different byte string of the items left is fetched once, with the number of its occurrences.
3. A window of an item holds the 84 bytes before its anchor or the 84 bytes behind it. A string that occurs once and
   shares neither stretch with another string of its anchor has no repeated window, and goes.
4. All other strings of an anchor are put into one transform (`collection_bwt`), those of several occurrences twice.
   Windows with a common prefix of `length` bytes with a neighbour repeat.
5. An anchor with more than `most_strings` strings is cut into cells first: the offsets of the anchor in its windows are
   halved, and each half of a string goes to the cell of the bytes that all windows of that half share. That goes on
   until cells are small; a cell of one offset has one string. Cells go through the transform like anchors.

Hashes only group equal strings and leave out those that cannot repeat; what repeats comes from the transform. Keys with
over a thousandth of all rows are joined by broadcast. Texts are shuffled twice, once for step 2 and once to be cut; rows
of a text stream past it and are never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common
from engram.llm.collection_bwt import repeated

GRAM = 32
#: Longer texts are searched in tiles of so many window starts.
TILE = 1 << 23
ITEMS = pa.schema(
    [("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64())]
    + [("windows", pa.int32()), ("at", pa.int32())]
)
ITEMS_DDL = "anchor long, content long, doc_id long, tie long, lo long, windows int, at int"
STRINGS = pa.schema(
    [("cell", pa.int64()), ("content", pa.int64()), ("root", pa.int64()), ("root_content", pa.int64()), ("shift", pa.int32()), ("at", pa.int32())]
    + [("n", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("lo", pa.int64()), ("before", pa.int64()), ("after", pa.int64())]
    + [("bytes", pa.binary())]
)
STRINGS_DDL = (
    "cell long, content long, root long, root_content long, shift int, at int, n long, doc_id long, tie long, lo long, before long, after long, bytes binary"
)
RUNS = pa.schema([("cell", pa.int64()), ("content", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _grams(data: np.ndarray) -> np.ndarray:
    h, k = common.BYTE_CODE[data], 1
    while k < GRAM:
        h = h[: len(h) - k] * common.powers(k + 1)[k] + h[k:]
        k *= 2
    return common.mix(h)


def items(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, anchor hash, first window, number of windows, anchor from there) of items, in tiles of joined texts."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(x) for x in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    span = length - GRAM + 1
    for base in range(0, max(len(data) - length + 1, 0), TILE):
        tile = data[base : base + TILE + length - 1]
        grams = _grams(tile)
        low = np.uint64((1 << 24) - 1)
        least, k = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * k <= span:
            least = np.minimum(least[: len(least) - k], least[k:])
            k *= 2
        if k < span:
            least = np.minimum(least[: len(least) - (span - k)], least[span - k :])
        starts = np.arange(base, base + len(least))
        owner = np.searchsorted(ends, starts, side="right")
        ok = starts + length <= ends[np.minimum(owner, len(ends) - 1)]
        starts, owner, at = starts[ok], owner[ok], (least[ok] & low).astype(np.int64)
        if not len(starts):
            continue
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate((first, [len(starts)])))
        whose = owner[first]
        yield whose, grams[at[first]].view(np.int64), starts[first] - (ends[whose] - sizes[whose]), count, at[first] + base - starts[first]



def _hash(data: bytes | memoryview) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def beside_texts(docs: DataFrame, facts: DataFrame, texts_first: bool) -> DataFrame:
    """Rows of docs (doc, tie, row) and facts (doc, tie, lo, fact) of one text together: is_fact, doc, tie, row, lo, fact."""
    row, fact = docs.schema["row"].dataType, facts.schema["fact"].dataType
    texts = docs.select(F.lit(False).alias("is_fact"), "doc", "tie", "row", F.lit(None).cast("long").alias("lo"), F.lit(None).cast(fact).alias("fact"))
    both = texts.union(facts.select(F.lit(True), "doc", "tie", F.lit(None).cast(row), "lo", "fact"))
    first = F.col("is_fact") if texts_first else ~F.col("is_fact")
    return both.repartition("doc", "tie").sortWithinPartitions("doc", "tie", first, "lo")


class Repeats:
    def __init__(self, docs: DataFrame, length: int, most_strings: int):
        self.docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
        self.length, self.most = length, most_strings
        self.scratch = common.Scratch(docs.sparkSession, "suffix-dedup")

    def items(self) -> DataFrame:
        length = self.length

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.rows(batches):
                texts = [common.utf8(x) for x in part["text"]]
                doc, tie = part["doc_id"], np.array(part["tie"], dtype=np.int64)
                known = pa.array(doc, type=pa.int64())
                for whose, anchor, lo, count, at in items(texts, length):
                    stop = lo + count + (length - 1)
                    views = [memoryview(x) for x in texts]
                    digest = xxhash.xxh3_64_intdigest
                    content = np.array([digest(views[w][a:b]) for w, a, b in zip(whose.tolist(), lo.tolist(), stop.tolist(), strict=True)], dtype=np.uint64)
                    columns = {"anchor": anchor, "content": content.view(np.int64), "doc_id": known.take(pa.array(whose)), "tie": tie[whose]}
                    yield common.table(ITEMS, columns | {"lo": lo, "windows": count.astype(np.int32), "at": at.astype(np.int32)})

        return self.docs.mapInArrow(find, ITEMS_DDL)

    def strings(self, contents: DataFrame) -> DataFrame:
        """The bytes of (anchor, content, n, rep), each from the text of its representative, as rows of STRINGS.

        before and after are hashes of the anchor with the bytes on that side that windows of that half share.
        """
        length, side = self.length, (self.length - GRAM) // 2
        facts = contents.select("rep.doc_id", "rep.tie", "rep.lo", F.struct("anchor", "content", "n", "rep.windows", "rep.at").alias("fact"))
        texts = self.docs.select(F.col("doc_id").alias("doc"), "tie", F.struct("text").alias("row"))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, data = None, b""
            for part in common.rows(batches, text="row.text"):
                out: dict[str, list] = {f.name: [] for f in STRINGS}
                for is_fact, doc, tie, row, lo, fact in zip(*(part[c] for c in ("is_fact", "doc", "tie", "row", "lo", "fact")), strict=True):
                    if not is_fact:
                        if now != (doc, tie):
                            now, data = (doc, tie), common.utf8(row["text"])
                        continue
                    found = data[lo : lo + fact["windows"] + length - 1]
                    at, anchor, content = fact["at"], fact["anchor"], fact["content"]
                    before = _hash(found[at - side : at + GRAM]) if at >= side else None
                    after = _hash(found[at : at + GRAM + side]) if at - fact["windows"] + 1 < side else None
                    values = (anchor, content, anchor, content, 0, at, fact["n"], doc, tie, lo, before, after, found)
                    for k, x in zip(out, values, strict=True):
                        out[k].append(x)
                yield common.table(STRINGS, out)

        return beside_texts(texts, facts.withColumnRenamed("doc_id", "doc"), True).mapInArrow(fetch, STRINGS_DDL)

    def able(self, strings: DataFrame) -> DataFrame:
        """Strings that can have repeated windows."""
        sides = strings.select("cell", "content", "n", F.explode(F.array("before", "after")).alias("side")).where("side is not null")
        counted = self.scratch.write(sides.groupBy("cell", "side").agg(F.count("*").alias("n")).where("n > 1"), "sides")
        once = sides.where("n = 1").select("cell", "side", "content")
        shared = common.split_join(once, counted.select("cell", "side"), ["cell", "side"], common.heavy_keys(counted, ["cell", "side"], strings.count()))
        return strings.where("n > 1").union(strings.where("n = 1").join(shared.select("cell", "content").distinct(), ["cell", "content"], "left_semi").select(*strings.columns))

    def halves(self, strings: DataFrame, level: int) -> DataFrame:
        """The strings of crowded cells as two strings of half the offsets each, in cells by what their windows share."""
        length = self.length

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            width = max(length - GRAM + 1 >> level, 1)
            for part in common.rows(batches, 1 << 20, "bytes"):
                out: dict[str, list] = {f.name: [] for f in STRINGS}
                names = list(out)
                for row in zip(*(part[c] for c in names), strict=True):
                    x = dict(zip(names, row, strict=True))
                    data, at, windows = x["bytes"], x["at"], len(x["bytes"]) - length + 1
                    # Offsets of the anchor are dealt into ranges of `width`, the last of a level may be shorter.
                    for r in range((at - windows + 1) // width, at // width + 1):
                        low, high = r * width, (r + 1) * width - 1
                        a, b = max(0, at - high), min(windows - 1, at - low)
                        core = data[at - low : at - high + length]
                        text = data[a : b + length]
                        key = _hash(core + r.to_bytes(2, "little") + level.to_bytes(1, "little"))
                        values = x | {"cell": key, "content": _hash(text), "shift": x["shift"] + a, "at": at - a, "before": None, "after": None, "bytes": text}
                        for k in names:
                            out[k].append(values[k])
                yield common.table(STRINGS, out)

        return strings.mapInArrow(split, STRINGS_DDL)

    def transformed(self, strings: DataFrame) -> DataFrame:
        """(cell, content, a, b): runs of repeated windows of each string, by the transform of its cell."""
        length = self.length

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0

            def flush() -> pa.RecordBatch:
                out: dict[str, list] = {f.name: [] for f in RUNS}
                # What occurs several times stands in the collection twice.
                flags = repeated([x[3] for x in held] + [x[3] for x in held if x[2] > 1], length)
                for (cell, content, *_), found in zip(held, flags, strict=False):
                    a, b = _runs(found)
                    out["cell"] += [cell] * len(a)
                    out["content"] += [content] * len(a)
                    out["a"] += a
                    out["b"] += b
                return common.table(RUNS, out)

            last = None
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "content", "n", "bytes")), strict=True):
                    if row[0] != last and size > 96_000:
                        yield flush()
                        held, size = [], 0
                    last = row[0]
                    held.append(row)
                    size += len(row[-1])
            if held:
                yield flush()

        dealt = strings.select("cell", "content", "n", "bytes").repartition("cell").sortWithinPartitions("cell")
        return dealt.mapInArrow(compare, "cell long, content long, a int, b int")

    def runs(self, strings: DataFrame) -> DataFrame:
        """(root, root_content, n, doc_id, tie, lo, a, b): runs of repeated windows of the strings fetched."""
        level, done = 0, None
        while True:
            # One string for each content of a cell; at the first level they are so already.
            each = strings
            if level:
                each = strings.groupBy("cell", "content").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
                each = self.scratch.write(each, f"contents-{level}")
            sizes = each.groupBy("cell").agg(F.count("*").alias("n"), F.sum("n").alias("all")).where("all > 1")
            sizes = self.scratch.write(sizes, f"cells-{level}")
            crowded = sizes.where(F.col("n") > self.most).select("cell", "n")
            total = each.count()
            heavy = common.heavy_keys(sizes.select("cell", "n"), ["cell"], total)
            calm = common.split_join(each, sizes.where(F.col("n") <= self.most).select("cell"), ["cell"], heavy)
            found = self.scratch.write(self.transformed(calm.select("cell", "content", "n", "bytes")), f"runs-{level}")
            kept = strings.select("cell", "content", "root", "root_content", "shift", F.col("n").alias("m"), "doc_id", "tie", "lo")
            several = strings.groupBy("cell", "content").agg(F.count("*").alias("n")) if level else None
            hot = common.heavy_keys(several, ["cell", "content"], total) if level else None
            got = common.split_join(kept, found, ["cell", "content"], hot)
            got = got.select("root", "root_content", F.col("m").alias("n"), "doc_id", "tie", "lo", (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.col("b")).alias("b"))
            done = got if done is None else done.union(got)
            if crowded.isEmpty():
                return done
            level += 1
            more = common.split_join(strings, crowded.select("cell"), ["cell"], heavy).select(*strings.columns)
            strings = self.scratch.write(self.halves(more, level), f"strings-{level}")

    def spans(self) -> DataFrame:
        """(doc_id, tie, lo, hi): the windows that start at lo .. hi repeat."""
        found = self.scratch.write(self.items(), "items")
        often = self.scratch.write(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
        some = common.split_join(found, often.select("anchor"), ["anchor"], common.heavy_keys(often, ["anchor"], found.count()))
        some = self.scratch.write(some, "candidates")
        self.scratch.drop("items")
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie", "lo", "windows", "at")).alias("rep")
        contents = self.scratch.write(some.groupBy("anchor", "content").agg(F.count("*").alias("n"), rep), "contents")
        strings = self.scratch.write(self.strings(contents), "strings")
        able = self.scratch.write(self.able(strings), "able")
        runs = self.scratch.write(self.runs(able), "runs")
        once = runs.where("n = 1").select("doc_id", "tie", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi"))
        several = runs.where("n > 1").select(F.col("root").alias("anchor"), F.col("root_content").alias("content"), "a", "b")
        heavy = common.heavy_keys(contents, ["anchor", "content"], some.count())
        places = common.split_join(some.select("anchor", "content", "doc_id", "tie", "lo"), several, ["anchor", "content"], heavy)
        return once.union(places.select("doc_id", "tie", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi")))


def cut(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    """What is left of data without the byte ranges, which ascend and do not touch."""
    if not removed:
        return data
    return b"".join([data[a:b] for a, b in zip([0, *(b for _, b in removed)], [*(a for a, _ in removed), len(data)], strict=True)])


def with_repeats(docs: DataFrame, length: int, most_strings: int, write: Callable, ddl) -> DataFrame:
    """write(rows of `docs` as a struct array, list of their removed byte ranges) for batches of rows, in one shuffle."""
    spans = Repeats(docs.select("doc_id", "text"), length, most_strings).spans()
    facts = spans.select(F.col("doc_id").alias("doc"), "tie", "lo", F.struct("hi").alias("fact"))
    texts = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, removed = None, []
        for batch in batches:
            for part in common.slices(batch, text="row.text"):
                fact = part.column("fact").to_pylist()
                rows, gone = [], []
                for i, (is_fact, doc, tie, lo) in enumerate(zip(*(part.column(c).to_pylist() for c in ("is_fact", "doc", "tie", "lo")), strict=True)):
                    if now != (doc, tie):
                        now, removed = (doc, tie), []
                    if not is_fact:
                        rows.append(i)
                        gone.append(removed)
                        continue
                    end = fact[i]["hi"] + length
                    if removed and lo <= removed[-1][1]:
                        removed[-1] = (removed[-1][0], max(removed[-1][1], end))
                    else:
                        removed.append((lo, end))
                if rows:
                    yield write(part.column("row").take(pa.array(rows)), gone)

    return beside_texts(texts, facts, False).mapInArrow(run, ddl)


def remove_repeats(docs: DataFrame, length: int = 200, most_strings: int = 4_096) -> DataFrame:
    """Texts without the bytes of any `length`-byte string that also starts elsewhere in the corpus.

    For every row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept (the remaining
    bytes). Strings are judged on the input, matches end at the end of a document and may overlap. A null text is an
    empty one. Repeated rows count as further places of their text, null doc_ids stay null, other columns are not read,
    and an empty table gives no rows. `most_strings` is the size of a transform and decides no result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def digest(rows: pa.StructArray, gone: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, text, removed in zip(rows.field("doc_id").to_pylist(), rows.field("text").to_pylist(), gone, strict=True):
            data = common.utf8(text)
            kept = cut(data, removed)
            for k, x in zip(out, (doc, len(data), len(data) - len(kept), len(removed), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[k].append(x)
        return common.table(schema, out)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_repeats(docs.select("doc_id", "text"), length, most_strings, digest, ddl)


def without_repeats(docs: DataFrame, length: int = 200, most_strings: int = 4_096) -> DataFrame:
    """`docs`, all rows and columns, with those bytes cut from text and n_chars, if there is one, set anew.

    A character that is cut in part is left out whole. A text without repeats stays as it is, a null text stays null,
    null doc_ids and repeated rows stay, columns of any other name are kept as they are, and an empty table gives none.
    """
    names = docs.columns

    def shorten(rows: pa.StructArray, gone: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        columns = dict(zip(names, rows.flatten(), strict=True))
        texts = [cut(common.utf8(x), removed).decode("utf-8", "ignore") if removed else x for x, removed in zip(columns["text"].to_pylist(), gone, strict=True)]
        columns["text"] = pa.array(texts, type=columns["text"].type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if x is None else len(x) for x in texts], type=pa.int64()).cast(columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return with_repeats(docs, length, most_strings, shorten, docs.schema)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents without its repeated strings of 200 bytes; see `remove_repeats` for nulls and ties."""
    return remove_repeats(common.read(spark, sf_dir, "documents")).drop("kept")
