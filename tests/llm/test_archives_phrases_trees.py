"""op11 to op13 against brute force, on small tables with every awkward row, and damaged archives."""

import collections
import glob
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import collocations, merkle, warc

PAGES = "page_id long, url string, html string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- op13 ----------------------------------------------------------------------------------------------------------


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def tree(nodes: list[str], fan: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def path(levels: list[list[str]], at: int, node: str, fan: int) -> tuple[str, str]:
    """(all siblings, the top with `node` at place `at`)."""
    siblings = ""
    for level in levels[:-1]:
        first = at - at % fan
        run = level[first : first + fan]
        siblings += "".join(x for i, x in enumerate(run) if first + i != at)
        run[at - first] = node
        node, at = sha("".join(run)), at // fan
    return siblings, node


def brute_manifest(rows: list[tuple], fan: int) -> list[tuple]:
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    def shown(text, doc_id):
        if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 3:
            return text
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    groups = collections.defaultdict(list)
    for d, t, lang, s, n in rows:
        groups[lang].append((d, leaf(d, t, lang, s, n), leaf(d, shown(t, d), lang, s, n)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = tree([x[1] for x in groups[name]], fan)
    top = tree([trees[name][-1][0] for name in names], fan)
    out = []
    for j, name in enumerate(names):
        for i, (d, mine, other) in enumerate(groups[name]):
            low, sub = path(trees[name], i, other, fan)
            high, root = path(top, j, sub, fan)
            out.append((d, mine, trees[name][-1][0], top[-1][0], sha(low + high), root, root == top[-1][0]))
    return out


def doc_rows() -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, f"Text {i} Ü " + "Word " * int(rng.integers(0, 40)), ["en", "en", "en", "de", None, "", "und"][i % 7], "s", i) for i in range(150)]
    rows += [(7, "Text A", "en", "s", 1), (7, "Text B", "en", "s", 1), (7, "Text B", "en", "s", 1), (None, "No id", "en", None, None), (None, "no id", "en", None, None)]
    return [*rows, (900, None, "fr", None, None), (901, "", "it", "", 0), (902, "Long " * 50_000, "en", "s", 250_000)]


@pytest.mark.parametrize(("fan", "levels"), [(8, 3), (2, 2), (3, 1)])
def test_manifest(spark, fan, levels):
    docs = spark.createDataFrame(doc_rows(), DOCS).selectExpr("*", "1 AS grp", "2 AS idx", "'x' AS node", "3 AS block", "4 AS id").repartition(5)
    shown = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(docs["text"])
    got = [tuple(r) for r in merkle.manifest(docs, presented={"text": shown}, fan=fan, levels=levels).collect()]
    # Rows that are equal but for what they show are interchangeable, so they are told apart by all columns.
    assert sorted(map(str, got)) == sorted(map(str, brute_manifest(doc_rows(), fan)))
    assert {x[-1] for x in got} == {True, False}


def test_manifest_of_little(spark):
    docs = spark.createDataFrame(doc_rows(), DOCS)
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 900")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified
    lone = merkle.manifest(docs.where("doc_id in (900, 901)")).collect()
    assert len({r.root for r in lone}) == 1 and all(r.verified and r.leaf == r.subroot for r in lone)


def test_states_resume_where_they_were_copied():
    nodes = [sha(str(i)).encode() for i in range(20)]
    block = merkle.Block(nodes, 8, 2)
    for at in range(20):
        changed = [*nodes]
        changed[at] = sha("other").encode()
        rights = [right for _, right in block.siblings(at)]
        assert block.fold(at, changed[at], rights) == merkle.Block(changed, 8, 2).top[0]


# --- op11 ----------------------------------------------------------------------------------------------------------


def page_rows() -> list[tuple]:
    long = "<p>" + "same payload é " * 100
    rows = [(i, f"http://a/{i}", f"<html>{i}" + "x" * (i * 37)) for i in range(60)]
    rows += [(100, "http://c/1", long), (101, "http://c/2", long), (101, "http://c/3", long), (None, "http://c/4", long), (None, None, "n" * 2000), (None, None, "n" * 2000)]
    return [*rows, (200, None, None), (201, "", ""), (202, "a b\r\nWARC/1.1\r\n", "WARC/1.1\r\n\r\n"), (203, "u", "same short"), (204, "u", "same short"), (205, "u", "z" * 300_000)]


def expected(rows: list[tuple]) -> list[str]:
    most = {}
    for page, _, html in rows:
        most[html or ""] = max(most.get(html or "", -1), -1 if page is None else page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        other = len(data) >= 1000 and most[html or ""] >= 0 and page != most[html or ""]
        out.append(str((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", most[html or ""] if other else None)))
    return sorted(out)


def digest_rows(found) -> list[str]:
    number = lambda x: None if x is None or x.endswith("null") else int(x.rpartition(":")[2])
    rows = found.where("type in ('response', 'revisit')").collect()
    return sorted(str((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to))) for r in rows)


@pytest.mark.parametrize("compressed", [True, False])
def test_archives_round_trip(spark, tmp_path, compressed):
    pages = spark.createDataFrame(page_rows(), PAGES).selectExpr("*", "1 AS key", "'d' AS digest", "2 AS size", "3 AS first").repartition(3)
    at = f"{tmp_path}/archives"
    warc.write_archives(pages, at, compressed, archive_bytes=3000)
    found = warc.read_archives(spark, at, chunk_bytes=700).cache()
    assert digest_rows(found) == expected(page_rows())
    assert warc.quarantine(found).count() == 0
    texts = {r.payload_digest: bytes(r.payload) for r in found.where("type = 'response'").collect()}
    assert all(hashlib.sha1(x).hexdigest() == d for d, x in texts.items())
    files = glob.glob(f"{at}/part*")
    assert len(files) > 5 and all(next(iter(warc.salvage(open(f, "rb").read()))).kind == "warcinfo" for f in files)
    if compressed:  # any gzip reader reads them
        import gzip

        assert sum(gzip.open(f).read().count(b"WARC-Type: re") for f in files) == len(page_rows())


def test_large_groups_meet_by_broadcast(spark):
    rows = [(i, "u", "h" * 1500 if i % 3 else f"{i}" * 600) for i in range(300)] + [(1000 + i, "u", "p" * (1000 + i // 2)) for i in range(20)]
    found = warc.with_revisits(spark.createDataFrame(rows, PAGES)).collect()
    want = {}
    for page, _, html in rows:
        want.setdefault(html, []).append(page)
    assert sorted((r.page_id, r["first"]) for r in found) == sorted((p, max(ps) if len(ps) > 1 else None) for ps in want.values() for p in ps)


def test_empty_tables_of_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def damaged(parts: list[bytes]) -> list[tuple[bytes, set[int], list[tuple[int, int]]]]:
    """(archive, places of records that are whole, gaps) after each kind of damage to one of its records."""
    out = []
    starts = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).tolist()
    whole = b"".join(parts)
    for k in (0, 2, len(parts) - 1):
        rest = set(range(len(parts))) - {k}
        a, b = starts[k], starts[k + 1]
        middle = (a + b) // 2
        flipped = whole[:middle] + bytes([whole[middle] ^ 0x55]) + whole[middle + 1 :]
        out.append((flipped, rest, [(a, b)]))
        out.append((whole[: b - 9] + whole[b:], rest, [(a, b - 9)]))
        out.append((whole[:a] + b"\0junk\r\n" * 9 + whole[a:], rest | {k}, [(a, a + 63)]))
    out.append((whole[: starts[-1] - 5], set(range(len(parts) - 1)), [(starts[-2], starts[-1] - 5)]))
    out.append((b"no archive at all", set(), [(0, 17)]))
    return out


@pytest.mark.parametrize("compressed", [True, False])
def test_salvage_recovers_all_whole_records(spark, tmp_path, compressed):
    records = [warc.page_record(i, f"http://a/{i}", f"page {i} ".encode() * (30 + i), hashlib.sha1(f"page {i} ".encode() * (30 + i)).hexdigest(), 9, None, False) for i in range(6)]
    parts = [warc.member(x) if compressed else x for x in records]
    cases = damaged(parts)
    for data, whole, gaps in cases:
        found = list(warc.salvage(data))
        assert {int(x.headers["warc-record-id"].strip("<>").rpartition(":")[2]) for x in found if isinstance(x, warc.Record)} == whole
        assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == gaps
    for k, (data, _, _) in enumerate(cases):
        (tmp_path / f"a{k:02}.warc").write_bytes(data)
    log = warc.quarantine(warc.read_archives(spark, str(tmp_path))).orderBy("archive", "start").collect()
    assert [(r.start, r.end) for r in log] == [g for _, _, gaps in cases for g in gaps] and all(r.reason for r in log)


def test_salvage_of_odd_archives():
    good = warc.record("response", "urn:page:1", b"block", {})
    assert [type(x) for x in warc.salvage(warc.member(good + good))] == [warc.Record, warc.Record]  # one member, two records
    bad = good.replace(b"block", b"blocc")
    both = list(warc.salvage(warc.member(bad + good)))
    assert [type(x) for x in both] == [warc.Gap, warc.Record] and "digest" in both[0].reason
    assert [x.reason for x in warc.salvage(warc.member(b"no record"))] == ["member holds no record: no version line"]
    assert list(warc.salvage(warc.EMPTY_MEMBER)) == [] == list(warc.salvage(b""))
    folded = good.replace(b"WARC-Date", b"X-More: one\r\n two\r\nWARC-Date")
    assert next(iter(warc.salvage(folded))).headers["x-more"] == "one two"
    huge = warc.member(np.random.default_rng(0).bytes(17 << 20))
    assert huge[-1] == 0 and huge.endswith(warc.EMPTY_MEMBER)
    lying = good.replace(b"Content-Length: 5", b"Content-Length: 99999999999") + good
    assert [type(x) for x in warc.salvage(lying)] == [warc.Gap, warc.Record]


# --- op12 ----------------------------------------------------------------------------------------------------------


def brute_collocations(rows: list[tuple], support: int, top: int) -> list[tuple]:
    count, words = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    cands = {x: n for x, n in count.items() if n >= support and len(x[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        inside = [n for (other, q), n in cands.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * n >= 80 * a for n in inside):
            cuts = [(2000000 * a // (count[lang, p[:k]] + count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows() -> list[tuple]:
    rng = np.random.default_rng(8)
    pool = ["Old", "stone", "bridge", "river", "é", "ﬀ", "the", "a", "x-y", "the", "the", "\x0b", "mill."]
    rows = []
    for i in range(200):
        words = [pool[int(j)] for j in rng.integers(0, len(pool), 40)]
        if i % 3 == 0:
            words[5:5] = ["New", "York", "City", "Hall", "steps"]
        rows.append((i, "\t ".join(words[:20]) + ", " + " ".join(words[20:]), ["en", "fr", None, "und", "en"][i % 5], "s", 1))
    rows += [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, " .,;  ", "it", "s", 0), (None, "very long " * 20_000, "es", "s", 0), (303, "copy of it", "de", "s", 0)]
    return rows + [(303, "copy of it", "de", "s", 0)] * 40


@pytest.mark.parametrize("mining", [{}, {"fraction": 0.02, "slack": 1.0}, {"filter_bytes": 4096}, {"fraction": 0.001, "filter_bytes": 1 << 16}])
def test_collocations(spark, mining):
    docs = spark.createDataFrame(phrase_rows(), DOCS).selectExpr("*", "1 AS phrase", "2 AS words", "3 AS h", "4 AS n", "5 AS a").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(docs, support=12, top=50, **mining).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_collocations(phrase_rows(), 12, 50) and len({r[0] for r in got}) > 3


def test_border_failures_lead_to_further_passes(spark, monkeypatch):
    """A sample that proposes nothing still ends with all counts: words, then all that grows out of frequent ones, exactly."""
    passes = []
    count = collocations.count_phrases
    monkeypatch.setattr(collocations, "count_phrases", lambda *a, **b: passes.append(1) or count(*a, **b))
    docs = spark.createDataFrame(phrase_rows(), DOCS)
    found = collocations.frequent_phrases(docs, 12, 4, fraction=0.0)
    assert len(passes) == 4  # the sample, words by hash, words and larger phrases by hash, those exactly
    assert found.where("words = 4").count() > 0
    passes.clear()
    assert collocations.frequent_phrases(docs, 12, 4, fraction=1.0, slack=1.0).count() == found.count() and len(passes) == 2


def test_no_documents(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_filter_misses_nothing(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, 5000)
    frame = spark.createDataFrame([(int(x),) for x in h], "h long")
    for size in (4096, 8192, 1 << 18):
        bits = collocations.filter_of(frame, size)
        assert collocations.has(bits, h.view(np.uint64)).all()
    other = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    assert collocations.has(bits, other).mean() < 0.01
    more = collocations.filter_of(spark.createDataFrame([(7,)], "h long"), 1 << 18, bits)
    assert collocations.has(more, h.view(np.uint64)).all() and collocations.has(more, np.array([7], dtype=np.uint64)).all()
