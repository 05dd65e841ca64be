"""The training-data operators against brute force, on small tables with every awkward row."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest

from engram.llm import collection_bwt, decontamination, fingerprints, html_text, near_duplicates, packing, quality, sharding, suffix_dedup, token_counts, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the river rose in spring and people moved their boats to higher ground before the water reached the old stone bridge near the mill".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(PROSE[i] + (str(i * seed % 7) if i % 3 else "") for i in rng.integers(0, len(PROSE), n))


def texts() -> list[tuple]:
    shared = prose(99, 80)
    base = prose(5, 120)
    words = base.split()
    rows = [
        (1, prose(1, 200)), (2, ""), (3, None), (None, prose(2, 50)), (4, prose(1, 200)), (5, prose(3, 60) + " " + shared + " " + prose(4, 50)), (6, shared + prose(6, 90)), (7, base),
        (8, " ".join([*words[:60], "edited", *words[61:]])), (9, " ".join([*words[:20], "other", *words[21:100], "changed", *words[101:]])), (10, "one"), (11, "one"), (12, "two words"), (13, "ü" * 700), (14, "ab" * 4000),
        (1, prose(1, 200)), (15, "  spaced \n\n\t out <|endoftext|> é text  "), (16, " ".join(prose(k, 40) for k in range(20, 60))),
    ]
    return [(d, t, "en", "s", len(t) if t else 0) for d, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).withColumnsRenamed({}).selectExpr("*", "1 AS score", "2 AS size", "'x' AS label", "3 AS pid").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_collection_transform_finds_all_repeats():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = bytes(rng.choice(list(b"ab"), 60).tolist())
        held = []
        for _ in range(rng.integers(1, 10)):
            s = b""
            while len(s) < rng.integers(1, 90):
                i = rng.integers(0, 50)
                s += base[i : i + rng.integers(1, 30)] + bytes(rng.choice(list(b"abc"), rng.integers(0, 4)).tolist())
            held.append(s)
        count = {}
        for s in held:
            for i in range(len(s) - 15):
                count[s[i : i + 16]] = count.get(s[i : i + 16], 0) + 1
        assert [x.tolist() for x in collection_bwt.repeated(held, 16)] == [[count[s[i : i + 16]] > 1 for i in range(len(s) - 15)] for s in held]
    with pytest.raises(ValueError):
        collection_bwt.repeated([b"x"], 12)


@pytest.mark.parametrize("most_strings", [4096, 2, 1])
def test_suffix_dedup(docs, most_strings):
    data = [(d, (t or "").encode()) for d, t, *_ in texts()]
    count = {}
    for _, x in data:
        for i in range(len(x) - 199):
            count[x[i : i + 200]] = count.get(x[i : i + 200], 0) + 1
    want = []
    for d, x in data:
        gone = np.zeros(len(x) + 2, dtype=bool)
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(c for c, g in zip(x, gone[1:-1], strict=True) if not g)
        want.append((str(d), len(x), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.remove_repeats(docs, 200, most_strings).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


CLASHING = ["__tie", "__spans", "__d", "__key", "row", "doc", "tie", "fact", "is_fact", "lo", "root", "n", "a b"]


def clashing(docs):
    return docs.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(CLASHING)))


def test_suffix_dedup_keeps_columns(docs, empty):
    many = clashing(docs)
    out = suffix_dedup.without_repeats(many)
    assert out.columns == many.columns
    rows = out.collect()
    assert len(rows) == len(texts()) and all(r["a b"] == 12 and r.row == 4 for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert sorted(str(r.doc_id) for r in rows if r.text is None) == ["3"]
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.without_repeats(empty).count() == 0


def test_suffix_dedup_of_a_passage_in_many_contexts(spark):
    """One passage between different ends, as a crowded anchor that is cut into cells; and one very long text."""
    passage = prose(1, 60)
    rows = [(i, prose(100 + i, 7 + i % 5) + " " + passage + " " + prose(300 + i, 6), "en", "s", 0) for i in range(40)] + [(99, prose(7, 60_000), "en", "s", 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {}
    count = {}
    data = {r[0]: r[1].encode() for r in rows}
    for x in data.values():
        for i in range(len(x) - 199):
            count[x[i : i + 200]] = count.get(x[i : i + 200], 0) + 1
    for d, x in data.items():
        gone = np.zeros(len(x), dtype=bool)
        for i in range(len(x) - 199):
            if count[x[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want[d] = int(gone.sum())
    for most in (4096, 5):
        assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(table, 200, most).collect()} == want


def test_near_duplicates(docs, empty):
    held = texts()

    def shingles(text, size):
        w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if x]
        return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    for size in (2, 5):
        s = [shingles(t, size) for _, t, *_ in held]
        group = list(range(len(held)))
        for i in range(len(held)):
            for j in range(i):
                if s[i] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    a, b = group[i], group[j]
                    group = [b if g == a else g for g in group]
        want = []
        for i, (d, *_) in enumerate(held):
            ids = [held[j][0] for j in range(len(held)) if group[j] == group[i] and held[j][0] is not None]
            least = min(ids, default=None) if s[i] else d
            want.append((str(d), len(s[i]), str(least), d == least))
        got = near_duplicates.near_duplicates(docs, size).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == sorted(want)
    assert near_duplicates.near_duplicates(empty).count() == 0
    assert near_duplicates.one_of_each(empty).count() == 0
    many = clashing(docs)
    left = near_duplicates.one_of_each(many)
    assert left.columns == many.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None and r.doc_id < 5) == [1, 2, 3]


def test_crowds_lose_no_link(spark, monkeypatch):
    """A chain of edited texts of growing size: pivots join few of them, the others meet in their crowd."""
    import itertools

    words = prose(4, 400).split()
    rows = [(k, " ".join([*words[: 100 + 6 * k], *(f"own{k}x{i}" for i in range(9))]), "en", "s", 0) for k in range(40)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sets = [{tuple(x) for x in zip(*(t.split()[i:] for i in range(2)), strict=False)} for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    want = {i: min(k for k in range(len(rows)) if group[k] == group[i]) for i in range(len(rows))}
    assert len(set(want.values())) < len(rows) / 2
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(table, 2).collect()} == want


def test_components(spark):
    from engram.llm.common import Scratch
    from engram.llm.components import components

    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)] + [(300 + i, 300) for i in range(1, 30)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 150, 200)} | {(300 + i, 300) for i in range(30)}
    assert {tuple(r) for r in components(frame, Scratch(spark, "test"), "x").collect()} == want
    assert components(frame.limit(0), Scratch(spark, "test"), "x").count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])
    merged = np.maximum(near_duplicates.registers(a), near_duplicates.registers(b))
    assert (merged == near_duplicates.registers(np.union1d(a, b))).all()
    one = lambda x: near_duplicates.registers(x)[None, :]
    n = np.array([2000.0])
    assert near_duplicates.likely(one(a), one(b), n, n, 0.8)[0]
    assert not near_duplicates.likely(one(a), one(np.unique(pool[1500:])), n, np.array([1500.0]), 0.8)[0]


def test_tokens_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    odd = ["", None, " ", "  ", "\n", " a", "a ", "a  b", "a\n b", "a \nb\n\nc", "x<|endoftext|>y  <|endoftext|>", "tab\tq", " x y", "\x1c a b", "é　b c d", "don't  'll I'm 12 34's", "a\0b \0 c", "\r\n a b\r\n", "x$$$ y### ***z*** a,, b.. c'", "c²² d²$ e½. f1, g1"]
    cache = tokens.PieceCache(tokens.default_path(), tokens.packed, most=3)
    for _ in range(2):
        for text, keys in zip(odd, cache.prepare(odd), strict=True):
            assert b"".join(map(cache.__getitem__, keys)) == tokens.pack_ids(whole.encode(text or "", add_special_tokens=False).ids), text
    long = "x" * 100_000 + " " + "y-" * 5_000
    assert b"".join(map(cache.__getitem__, cache.prepare([long])[0])) == tokens.pack_ids(whole.encode(long, add_special_tokens=False).ids)
    cache.prepare(["a"])
    assert max(len(k) for k in cache if isinstance(k, str)) <= tokens.LONG  # the cache is bounded in bytes
    want = sorted((str(d), len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t, *_ in texts())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.BPE(vocab={"a": 0, "b": 1}, merges=[]))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(f"{tmp_path}/other.json")
    with pytest.raises(ValueError, match="byte-level"):
        tokens.PieceCache(f"{tmp_path}/other.json", tokens.number)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    rows = packing.pack(docs).collect()
    by_doc = {}
    for d, t, *_ in texts():
        by_doc.setdefault(d, []).append(np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    for r in rows:
        ids = by_doc[r.doc_id][0]
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.length == 1024 or r.piece == 0
    assert sum(r.length for r in rows) == sum(len(x) for xs in by_doc.values() for x in xs)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(empty).count() == 0


def test_packing_plan_fills_exact_gaps():
    slots, n = packing.plan({600: 3, 424: 2, 300: 1, 124: 1, 1024: 2, 5: 1}, 1024)
    assert n == 6 and sum(s[2] for s in slots) == 10
    counts = {int(k): int(v) for k, v in zip(*np.unique(np.random.default_rng(3).integers(1, 900, 4000), return_counts=True), strict=True)}
    _, n = packing.plan(counts, 1024)
    assert n <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 1


def test_sharding(docs, empty):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(texts())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    by_text = {}
    for r in rows:
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) == 1 for x in by_text.values())
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, *_ in texts())
    assert sharding.shard(empty).count() == 0


def test_sum_index_finds_what_enumeration_finds():
    import itertools

    rng = np.random.default_rng(6)
    for _ in range(20):
        free = np.concatenate(([0], rng.integers(0, 3, 30)))
        index = packing.SumIndex(free, most=3)
        for _ in range(40):
            total, taken = int(rng.integers(1, 31)), rng.choice(np.flatnonzero(free), 1).tolist() if free.any() else []
            left = free.copy()
            np.subtract.at(left, taken, 1)
            can = [c for k in (1, 2, 3) for c in itertools.combinations_with_replacement(range(30, 0, -1), k) if sum(c) == total and all(left[x] >= c.count(x) for x in c)]
            got = index.find(total, taken, step=4)
            assert got == (list(can[0]) if can else None)
            for x in [*taken, *(got or [])]:
                free[x] -= 1


def best_capacity(sizes, shards):
    best = [[0] + [10**12] * len(sizes)]
    for _ in range(shards):
        best.append([min(max(best[-1][j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(len(sizes) + 1)])
    return best[-1][-1]


def test_minimax_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 30, rng.integers(1, 12)).tolist()
        k = int(rng.integers(1, 5))
        capacity, cuts = sharding.minimax_cuts(sizes, k)
        assert capacity == best_capacity(sizes, k) and len(cuts) < k
        loads = [sum(sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
        assert max(loads) == capacity


@pytest.mark.parametrize("share", [0.0, 0.05, 0.1245, 0.3])
def test_sharding_cuts_exactly(spark, share):
    """Also with one group just under an even share, which leaves cuts much room."""
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 3000))
    sizes = rng.integers(1, 5000, len(keys))
    sizes[1100] += int(share / (1 - share) * sizes.sum())
    frame = spark.createDataFrame(list(zip(keys.tolist(), sizes.tolist(), strict=True)), "key long, size long").repartition(3)
    want, _ = sharding.minimax_cuts(sizes.tolist(), 8)
    for ranges in (16, 4096):
        cuts = sharding.cut_keys(frame, 8, ranges=ranges)
        at = np.searchsorted(keys, cuts)
        assert len(cuts) < 8 and max(np.add.reduceat(sizes, [0, *at])) == want


def test_shard_loads_are_optimal(spark, docs):
    for k in (1, 3, 8):
        loads, groups = {}, {}
        for r in sharding.shard(docs, k).collect():
            loads[r.shard] = loads.get(r.shard, 0) + r.size
            groups[r.text_crc32, r.size] = groups.get((r.text_crc32, r.size), 0) + r.size
        assert set(loads) <= set(range(k)) and sum(loads.values()) == sum(groups.values())
        left, own = sum(groups.values()), 0
        for size in sorted(groups.values(), reverse=True)[: k - 1]:
            if size * (k - own) <= left:
                break
            assert size in loads.values()
            left, own = left - size, own + 1
        assert max(loads.values()) <= max(max(groups.values()), left / (k - own) + sorted(groups.values())[-1 - own])


def test_fingerprints(docs, empty):
    order = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for i, (d, t, *_) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.setdefault(d, set()).add((len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    for rows_a_part in (2000, 4):
        rows = fingerprints.fingerprints(docs, rows_a_part).collect()
        assert len(rows) == len(order)
        assert all((r.n_chars, r.edited_sha256) in want[r.doc_id] for r in rows)
    same = {}
    for r in rows:
        same.setdefault(r.fingerprint, []).append(r.doc_id)
    assert [1, 1, 4] in [sorted(x) for x in same.values() if None not in x]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    a, b = prose(1, 200), prose(1, 150) + prose(77, 50)
    assert fingerprints.digest(fingerprints.signature(a, b[-200:])[1]) == fingerprints.digest(fingerprints.signature(a[: len(a) - len(a) // 4] + b[-200:])[0])
    assert fingerprints.fingerprints(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    insults = ["idiot", "moron", "scum"]
    rows = []
    for i in range(300):
        bad = i % 5 == 0
        w = prose(i, 60).split()
        if bad:
            w[int(rng.integers(0, 60))] = insults[i // 5 % 3]
        rows.append((i, " ".join(w), "en", "s", 0, int(bad)))
    table = spark.createDataFrame(rows, SCHEMA + ", toxic int")
    labels = table.selectExpr("doc_id", "1 AS quality", "toxic").union(table.selectExpr("CAST(NULL AS LONG)", "1", "CAST(NULL AS INT)").limit(1))
    got = toxicity.toxicity(table.drop("toxic"), labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == rows[r.doc_id][5] for r in held]) > 0.95
    model = toxicity.train([(r[1], r[5]) for r in rows])
    assert all(s >= 0.5 for s in model.scores(["you are an i.d.i.o.t now", "what a mor-on he is", "such an i d i o t"]))
    split, clean = model.scores(["such an id iot"])[0], model.scores(["the river rose in spring"])[0]
    assert clean < split and clean < 0.5  # a split insult has a kernel
    assert model.scores([None, ""]) == model.scores(["", None])
    repeated = table.drop("toxic").union(table.drop("toxic").selectExpr("doc_id", "concat(text, ' again')", "lang", "source", "n_chars"))
    assert toxicity.training_rows(repeated, labels, 5, 0, 10).count() == 20
    assert toxicity.fit(repeated, labels, most_rows=50, most_chars=2_000).table.shape == (64**3,)
    many = clashing(table.drop("toxic"))
    assert toxicity.without_toxic(many, labels, model).columns == many.columns
    assert toxicity.without_toxic(empty, labels, model).count() == 0
    assert toxicity.toxicity(docs, labels, model).count() == docs.count()
    assert toxicity.without_toxic(docs, labels, model).columns == docs.columns
    assert toxicity.toxicity(empty, labels, model).count() == 0
    assert toxicity.train([]).scores(["x"])[0] < 1 and toxicity.train([("x", 0)]).scores(["x"])[0] < 0.5


def test_toxicity_trains_without_copies():
    """The driver holds one matrix of landmarks and one of features; copies for a step are small. It took 236 MB before."""
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(5, 10, 3000)]
    rows = [(" ".join([*rng.choice(words, 20), *(["you", "moron"] if i % 10 == 0 else [])]), int(i % 10 == 0)) for i in range(1000)]
    tracemalloc.start()
    model = toxicity.train(rows, passes=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160e6
    insult, word = model.scores(["you moron", words[0]])
    assert insult > 0.9 and word < 0.1


def explicit_features(text):
    """Weights of all gapped subsequences of a string, by enumeration, scaled to length 1."""
    import itertools
    import math

    out = {}
    for i, j, k in itertools.combinations(range(len(text)), 3):
        if k - i < toxicity.SPAN:
            out[text[i], text[j], text[k]] = out.get((text[i], text[j], text[k]), 0.0) + toxicity.DECAY ** (k - i + 1)
    size = math.sqrt(sum(x * x for x in out.values()))
    return {k: x / size for k, x in out.items()}


def test_kernel_equals_enumeration():
    model = toxicity.Model("abcdefghij klmnopqrstuvwxyz", np.zeros(toxicity.LETTERS**3), 0.0)
    words = ["idiot", "banana", "aaaaaa", "id iot", "abcdef", "river", "no", "a"]
    rows = []
    for w in words:
        s = toxicity.Stretches([f" {w} "], model.codes)
        longest = int(np.argmax(s.end - s.start))
        _, key, value = toxicity.subsequences(s.code, s.start[[longest]], s.end[[longest]])
        rows.append(dict(zip(key.tolist(), value.tolist(), strict=True)))
    wanted = [explicit_features(f" {w} ") for w in words]
    dot = lambda a, b: sum(x * b.get(k, 0.0) for k, x in a.items())
    for i in range(len(words)):
        assert dot(rows[i], rows[i]) == pytest.approx(1.0)
        for j in range(len(words)):
            assert dot(rows[i], rows[j]) == pytest.approx(dot(wanted[i], wanted[j]))
    assert dot(rows[0], rows[3]) > dot(rows[0], rows[5])  # a gap weakens, and does not undo


def test_text_margin_is_the_largest_over_all_stretches():
    rng = np.random.default_rng(3)
    model = toxicity.Model("abcdefghij klmnopqrstuvwxyz", rng.normal(size=toxicity.LETTERS**3), -0.25)
    held = [prose(k, 5 + 9 * k) + ". " + prose(50 + k, 7) for k in range(8)] + ["", "one", "x" * 70]
    prepared = [toxicity.prepare(x) for x in held]
    s = toxicity.Stretches(prepared, model.codes)
    row, key, value = toxicity.subsequences(s.code, s.start, s.end)
    each = np.bincount(row, weights=value * model.table[key], minlength=len(s.start))
    want = [max([0.0, *each[s.owner == i]]) - 0.25 for i in range(len(held))]
    assert model.margins(prepared) == pytest.approx(want, abs=1e-5)


def test_svm_is_at_its_optimum():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(80, 6)), np.where(rng.random(80) < 0.4, 1.0, -1.0)
    weight = rng.random(80)
    weight /= weight.sum()
    loss = lambda w, b: weight @ np.maximum(0, 1 - y * (x @ w + b)) ** 2 + 0.5 * 1e-3 * w @ w
    w, b = toxicity._svm(x, y, weight, reg=1e-3)
    for _ in range(300):
        assert loss(w, b) <= loss(w + rng.normal(size=6) * 0.02, b + rng.normal() * 0.02) + 1e-9


def test_decontamination(spark, docs, empty):
    items = [(i, prose(500 + i, 40) + ". " + prose(700 + i, 12) + ".") for i in range(20)] + [(99, None), (98, ""), (97, prose(900, 150) + ".")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    leak = [(100, prose(3, 300) + " " + items[4][1] + " " + prose(8, 90)), (101, items[7][1]), (102, prose(9, 400)), (103, prose(700 + 3, 12)), (104, None), (105, prose(11, 100) + items[-1][1])]
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in leak], SCHEMA)
    rows = {}
    for part in (4096, 8, 1):
        rows[part] = sorted(map(tuple, decontamination.leaks(table, benchmark, items_a_part=part).collect()))
        assert {r[:2] for r in rows[part]} == {(100, 4), (101, 7), (105, 97)}
        assert sorted(r.doc_id for r in decontamination.without_leaks(table, benchmark, items_a_part=part).collect()) == [102, 103, 104]
    assert rows[4096] == rows[8] == rows[1]  # parts change no score
    many = clashing(table)
    assert decontamination.without_leaks(many, benchmark).columns == many.columns
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontamination.leaks(empty, benchmark).count() == 0 and decontamination.without_leaks(empty, benchmark).count() == 0


def test_disguised_insults_and_held_out_texts():
    """Insults with a character put in or doubled or a blank within, none of which `prepare` undoes; rows never trained on."""
    import duckdb

    at = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select d.doc_id, d.text, max(l.toxic) from '{at}/documents.parquet' d join '{at}/labels.parquet' l using (doc_id) group by 1, 2 order by hash(d.doc_id)").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    train, size = [], 0
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 5 and size + len(r[1] or "") < 6_000_000:
            train.append(r[1:])
            size += len(r[1] or "")
    model = toxicity.train(train)
    truth, said = np.array([r[2] for r in held]), np.array(model.scores([r[1] for r in held])) >= 0.5
    assert (said & (truth == 1)).sum() >= 0.88 * said.sum() and (said & (truth == 1)).sum() >= 0.82 * truth.sum()
    plain = ["idiot", "moron", "scum", "stupid", "pathetic", "loser", "trash", "worthless"]
    assert min(model.scores([f"You are such a {w} and the river rose." for w in plain])) >= 0.5
    forms = ["idxiot", "idiiot", "id iot", "morxon", "mororn", "mor on", "scxum", "scuum", "sc um", "stuxpid", "stuppid", "stu pid", "wortxhless", "worthhless", "wort hless", "traxsh", "traash"]
    found = [w for w, x in zip(forms, model.scores([f"You are such a {w} and the river rose." for w in forms]), strict=True) if x >= 0.5]
    assert len(found) >= len(forms) - 3, found
    assert max(model.scores(["The river rose in spring.", "", None, "An idle idol in a stupor; the lost trap of Oscar."])) < 0.5


@pytest.mark.parametrize("page", ["<div>" * 30_000 + "</x>" * 30_000, "<a " * 50_000, "<center>" * 30_000, "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<!-- x " * 30_000])
def test_broken_pages_are_read_in_one_pass(page):
    """Ends that match nothing, tags without an end, any depth: no tag looks through the stack or to the end of the page."""
    import time

    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 5  # a minute and more when each tag looked


@pytest.mark.parametrize("n", [72, 500, 800, 1500, 4000])
def test_long_items_leak_whole_and_embedded(n):
    """Items of any length: whole, within another text, and not where only a third of them stands."""
    rng = np.random.default_rng(n)
    vocabulary = [f"w{k}" for k in range(20_000)]
    fresh = lambda k: " ".join(vocabulary[i] for i in rng.integers(0, len(vocabulary), k))
    items = [(i, fresh(m) + ". " + fresh(20) + ".") for i, m in enumerate((n, 60, 300))]
    df, lengths = {}, []
    for _, text in items:
        for piece in decontamination.segments_of(text):
            lengths.append(len(piece))
            for t in np.unique(piece).tolist():
                df[t] = df.get(t, 0) + 1
    index = decontamination.build(items, df, len(lengths), sum(lengths) / len(lengths))
    third = " ".join(items[0][1].split()[: n // 3])
    texts = [items[0][1], fresh(700) + " " + items[0][1] + " " + fresh(900), fresh(300) + " " + third + " " + fresh(300), fresh(2000), None, items[2][1] + items[0][1]]
    found = decontamination.matches(decontamination.Searcher(index, 0.4), texts, 0.6)
    assert {(t, item) for t, item, *_ in found} == {(0, 0), (1, 0), (5, 0), (5, 2)}
    assert all(q > 0.98 and r > 0.9 for *_, q, r in found)


def bm25(items, passages):
    """Scores of word sets against items of at most 64 words, by the formula and without an index."""
    import math

    split = [[w.lower() for w in x.replace(".", " ").split()] for x in items]
    mean = sum(map(len, split)) / len(split)
    out = []
    for words in split:
        weight = {}
        for w in set(words):
            df, tf = sum(w in x for x in split), words.count(w)
            weight[w] = math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        out.append([sum(x for w, x in weight.items() if w in p) / sum(weight.values()) for p in passages])
    return out


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.7])
def test_wand_finds_what_scoring_all_finds(threshold):
    items = [(i, prose(500 + i, 30 + i % 30)) for i in range(60)]
    df, lengths = {}, []
    for _, text in items:
        for piece in decontamination.segments_of(text):
            lengths.append(len(piece))
            for t in np.unique(piece).tolist():
                df[t] = df.get(t, 0) + 1
    index = decontamination.build(items, df, len(lengths), sum(lengths) / len(lengths))
    held = [" ".join(prose(500 + k, 30 + k % 30)[: 30 * k] for k in range(0, 60, 7)) + prose(1, 300), prose(9, 500), "", prose(517, 47)]
    hashes, counts = decontamination.common.word_hashes([x.encode() for x in held], decontamination.common.NO_WORD)
    got = {(t, f, s): x for t, f, s, x in zip(*(x.tolist() for x in decontamination.Searcher(index, threshold).retrieve(hashes, counts)), strict=True)}
    want = {}
    for n, text in enumerate(held):
        words = text.lower().split()
        passages = [set(words[f : f + 64]) for f in range(0, len(words), 32)]
        for s, scores in enumerate(bm25([t for _, t in items], passages)):
            want |= {(n, 32 * i, s): x for i, x in enumerate(scores) if x >= threshold}
    assert got == pytest.approx(want)


def test_quality(spark, docs, empty):
    rows = [(i, prose(i, 40) if i % 4 else "### $$$ %%% " * 10, i % 4 and 1 + i % 2) for i in range(200)]
    table = spark.createDataFrame([(d, t, "en", "s", 0) for d, t, _ in rows], SCHEMA)
    ratings = spark.createDataFrame([(d, int(g)) for d, _, g in rows] + [(None, 1), (5, None)], "doc_id long, grade int")
    got = quality.quality(table, ratings, 1).collect()
    assert np.mean([r.kept == (rows[r.doc_id][2] >= 1) for r in got if r.held_out]) > 0.95
    model = quality.train([t for _, t, _ in rows], [int(g) for *_, g in rows])
    tails = model.tails(["the river", "", None])
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert quality.quality(docs, ratings.limit(0), 1).where("kept").count() == docs.count()
    assert quality.quality(empty, ratings, 1).count() == 0


def test_likelihood_by_hand_and_its_gradient():
    rng = np.random.default_rng(9)
    n = np.array([2, 1, 3, 2])
    column, value, y = rng.integers(0, 5, 8), rng.normal(size=8), np.array([0, 2, 1, 3])
    state = np.concatenate((rng.normal(size=5), [-0.4], rng.normal(size=2) * 0.3))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    theta = state[5] + np.array([0.0, np.exp(state[6]), np.exp(state[6]) + np.exp(state[7])])
    total, at = 0.0, 0
    for size, grade in zip(n, y, strict=True):
        score = sum(state[c] * x for c, x in zip(column[at : at + size], value[at : at + size], strict=True))
        tails = [1.0, *sigmoid(score - theta), 0.0]
        total += np.log(tails[grade] - tails[grade + 1])
        at += size
    got, slope = quality.likelihood(state, y, column, value, n, 4)
    assert got == pytest.approx(total / 4)
    for i in range(len(state)):
        step = np.zeros(len(state))
        step[i] = 1e-6
        up, down = quality.likelihood(state + step, y, column, value, n, 4)[0], quality.likelihood(state - step, y, column, value, n, 4)[0]
        assert slope[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_phrases_by_hand():
    """The parse of a text into the shortest phrases not seen before, by a set of strings."""
    for text in ("abababab", "aaaaaaa", prose(2, 80), "x", "", "ab" * 100 + "ba" * 50):
        seen, ends, start = set(), [], 0
        for i in range(1, len(text) + 1):
            if text[start:i] not in seen:
                seen.add(text[start:i])
                ends.append(i)
                start = i
        assert fingerprints.Parser().ends(text) == ends


def test_html(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Head &amp; more</h1><p><b>First\n  part<br>of it.'
        '<p>Second &lt;p&gt; part.</p><aside class="sidebar"><p>Aside.</p></aside><form><label>Name</label><input></form><script>var t="</p>";</script><div class="comments"><p>A reader says.</p></div></article><footer>&copy; us</footer></body></html>'
    )
    table = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p a=\"x>broken<<>"), (1, "u", page)], "page_id long, url string, html string").selectExpr("*", "'z' AS text")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.main_text(table).collect()}
    text = "Head & more\nFirst part of it.\nSecond <p> part."
    assert got[1, "u"] == (text, len(text)) and got[2, None] == ("", 0) and got[3, "v"] == ("", 0)
    assert html_text.main_text(table.limit(0)).count() == 0
    model = html_text.train(html_text.labelled_pages())
    extract = lambda body: model.extract(f"<body><nav><a href=/>Menu</a></nav><article><h1>Title of it</h1><p>The first paragraph of a text.</p>{body}<p>The last one of it.</p></article></body>").split("\n")
    first, last = ["Title of it", "The first paragraph of a text."], ["The last one of it."]
    for body, want in (
        ('<svg class="i"/><p>Behind a drawing.</p>', ["Behind a drawing."]),
        ("<svg><title>t</title><text>drawn</text></svg><p>Behind it.</p>", ["Behind it."]),
        ("<div><select><option>one<option>two</div><p>Behind a choice.</p>", ["Behind a choice."]),
        ('<p>See <a href="/l">a long link text in a paragraph</a>.</p>', ["See a long link text in a paragraph."]),
        ('<ul><li><a href="/a">The first thing that is linked</a></li><li><a href="/b">The second thing</a></li></ul>', ["The first thing that is linked", "The second thing"]),
        ('<div class="note">A remark of the author on this.</div>', ["A remark of the author on this."]),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", ["Let x=2 be."]),
        ("<script>if (a < b) document.write('<p>no</p>')</script>", []),
        ("<form><label>Name</label><input><button>Send</button></form>", []),
    ):
        assert extract(body) == first + want + last, body
    long = "<p>" + prose(3, 40_000) + "</p>"
    assert extract(long)[2] == prose(3, 40_000)
    assert model.extract("<p>" * 3000 + "deep and long enough to be a text." + "</p>" * 3000)


def test_structure_labels_and_held_out_accuracy(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.fit(pages)
    held = [r.html for r in pages.where("crc32(CAST(page_id AS STRING)) % 5 = 0").collect()]
    n, share = html_text.accuracy(model, [p for x in held if (p := html_text.by_structure(x))])
    assert n > 100 and share > 0.98
    page = html_text.by_structure("<nav>a</nav><main>b<aside>c</aside><div class=comments>d</div><p>e</main>f")
    assert [(n.text, n.label) for n in page.nodes if n.text] == [("a", 0), ("b", 1), ("c", 0), ("d", 0), ("e", 1), ("f", 0)]
    assert html_text.by_structure("<p>no sections") is None and html_text.by_structure(None) is None


def test_marginals_equal_enumeration():
    import itertools
    import math

    model = html_text.train(html_text.labelled_pages())
    page = html_text.parse("<body><nav><a href=x>menu</a></nav><article><p>Some longer text of a page.</p></article></body>")
    n = len(page.nodes)
    total, inside = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        p = model.root[y[0]]
        for i, node in enumerate(page.nodes):
            p += sum(model.own.get(t, (0.0, 0.0))[y[i]] for t in node.traits) + (model.edge[node.marked][y[node.parent]][y[i]] if i else 0.0)
        total += math.exp(p)
        for i in range(n):
            inside[i] += math.exp(p) * y[i]
    assert model.marginals(page) == pytest.approx([x / total for x in inside])
