"""The pipeline end to end: each stage on what the one before has kept."""

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == docs.columns and after.count() <= before.count(), name
        assert after.join(before, "doc_id", "left_anti").count() == 0
        before = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def _folder(spark, sf_dir, at, docs):
    docs.write.parquet(f"{at}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{at}/{table}.parquet")
    return str(at)


def test_awkward_rows_go_through_all_stages(spark, sf_dir, tmp_path):
    """Nulls, empties, repeats, copies, a leak, an insult and columns with clashing names; then no row at all."""
    clean = " ".join(f"word{i}" for i in range(300))
    shared = " ".join(f"shared{i}" for i in range(60))
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(1, clean), (2, None), (3, ""), (None, "no id but words enough for a text of its own"), (4, clean), (4, clean), (5, shared + " " + " ".join(f"a{i}" for i in range(90))), (6, " ".join(f"b{i}" for i in range(90)) + " " + shared), (7, leak), (8, "z" * 5000)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS nid", "2 AS part", "'x' AS score", "3 AS item_id", "4 AS length")
    at = _folder(spark, sf_dir, tmp_path / "some", docs)
    pieces = corpus_pipeline.run(spark, at).collect()
    ids = {r.doc_id for r in pieces}
    assert ids == {1, 2, 3, None, 5, 6, 8}
    per_text = {}
    for r in pieces:
        per_text.setdefault(r.doc_id, []).append(r)
    assert all(sorted(p.start for p in x)[0] == 0 and all(0 < p.length <= 1024 for p in x) for x in per_text.values())
    assert per_text[2][0].length == per_text[3][0].length == 1  # the end token alone
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        at_ = 0
        for offset, length in sorted(x):
            assert offset == at_
            at_ += length
        assert at_ <= 1024
    none = _folder(spark, sf_dir, tmp_path / "none", docs.limit(0))
    assert corpus_pipeline.run(spark, none).count() == 0
