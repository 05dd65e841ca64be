"""Token counts of whole texts (op4), without a shuffle of pre-tokens.

Two tiers at the map side. A compact hash table of the lengths of frequent pre-tokens is broadcast; its size is bounded
by `table_size` and it is filled from at most `sample_rows` texts, which changes speed and never a count. What it
lacks is encoded once per worker and kept in that worker's cache, which is emptied when it holds `cache_size` pieces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import common, tokens

FREQUENT = pa.schema([("key", pa.string()), ("n", pa.int64()), ("length", pa.int64())])
COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def frequent_lengths(docs: DataFrame, path: str, table_size: int, sample_rows: int) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of `sample_rows` texts: at most `table_size` entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.PieceCache(path, tokens.number)
        for part in common.rows(batches):
            seen = Counter(k for keys in cache.prepare(part["text"]) for k in keys if isinstance(k, str) and len(k) < 40)
            top = seen.most_common(table_size)
            yield common.table(FREQUENT, {"key": [k for k, _ in top], "n": [n for _, n in top], "length": [cache[k] for k, _ in top]})

    found = docs.select("text").limit(sample_rows).mapInArrow(count, "key string, n long, length long")
    best = found.groupBy("key", "length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(table_size)
    return {r.key: r.length for r in best.collect()}


def token_counts(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    limit: int = 1024,
    table_size: int = 20_000,
    sample_rows: int = 400,
    cache_size: int = 800_000,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of `docs`.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows each give a row, a null doc_id stays null, other
    columns are not read, and an empty table gives no rows. Texts are never cut, whatever their length.
    """
    path = tokenizer_path or tokens.default_path()
    seed = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_size, sample_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokens.worker_cache(path, tokens.number, cache_size, seed.value)
        get = cache.__getitem__
        for part in common.rows(batches):
            n = [sum(map(get, keys)) for keys in cache.prepare(part["text"])]
            size = [len(common.utf8(x)) for x in part["text"]]
            yield common.table(COUNTED, {"doc_id": part["doc_id"], "n_bytes": size, "n_tokens": n, "over_limit": [x > limit for x in n]})

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"))
