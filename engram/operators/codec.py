"""Compressed vectors that are searched as they are: rotation, Lloyd-Max centroids, packed codes, signs of the residual.

A unit vector is turned by a fixed random rotation, after which each coordinate is distributed as one of a random point of
the sphere; centroids that minimise the mean square error for that distribution stand for it in 2, 4 or 8 bits. Codes of
4 bits or fewer also keep the signs of 128 random projections of what coding leaves over. A query is turned once and meets
codes by their centroids and signs by its own projections, so no vector is decoded into a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import views
from engram.operators.lexical import best
from engram.operators.lifecycle import _retention
from engram.operators.vectors import BLOCK, dot, norm, query_vectors, topk
from engram.registry import query

SEED, LANES = 7, 128
#: What a score of each tier is worth: exact, 8 bits, packed.
FULL, BYTE, PACKED = 1.0, 0.98, 0.97
CODES = pa.schema([("fact_id", pa.int64()), ("radius", pa.float32()), ("bits", pa.int32()), ("codes", pa.binary()), ("signs", pa.binary()), ("rest", pa.float32()), ("error", pa.float64())])
CODES_DDL = "fact_id long, radius float, bits int, codes binary, signs binary, rest float, error double"


@lru_cache(maxsize=32)
def centroids(bits: int, size: int, rounds: int = 300, grid: int = 100_001) -> np.ndarray:
    """Lloyd-Max centroids of a coordinate of a random unit vector of `size` dimensions: each is the mean of what lies nearer
    to it than to any other, by iteration on a grid of the density (1 - x²) ** ((size - 3) / 2)."""
    x = np.linspace(-1, 1, grid)[1:-1]
    weight = (1 - x * x) ** ((size - 3) / 2)
    share = np.cumsum(np.cbrt(weight)) / np.cbrt(weight).sum()  # the density of many centroids; few move from there
    n = 1 << bits
    found = np.interp((np.arange(n) + 0.5) / n, share, x)
    total, moment = np.concatenate(([0], np.cumsum(weight))), np.concatenate(([0], np.cumsum(weight * x)))
    for _ in range(rounds):
        edge = np.concatenate(([0], np.searchsorted(x, (found[1:] + found[:-1]) / 2), [len(x)]))
        mass = np.diff(total[edge])
        new = np.where(mass > 0, np.diff(moment[edge]) / np.where(mass > 0, mass, 1), found)
        if np.abs(new - found).max() < 1e-9:
            break
        found = new
    return found


@lru_cache(maxsize=8)
def projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation, and the rays whose signs are kept; the same in every task."""
    rng = np.random.default_rng(SEED)
    return np.linalg.qr(rng.standard_normal((size, size)))[0], rng.standard_normal((LANES, size))


def pack(code: np.ndarray, bits: int) -> np.ndarray:
    """Rows of codes in `bits` bits each, as rows of bytes."""
    return np.packbits(((code[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).reshape(len(code), -1), axis=1)


def unpack(packed: np.ndarray, bits: int, size: int) -> np.ndarray:
    each = np.unpackbits(packed, axis=1)[:, : size * bits].reshape(len(packed), size, bits)
    return (each.astype(np.int64) << np.arange(bits - 1, -1, -1)).sum(axis=2)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.linalg.norm(x, axis=1)
    return np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0), length


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(radius, packed codes, packed signs or None, length of what coding leaves over) of rows of vectors."""
    flat, radius = _unit(x)
    turn, rays = projections(x.shape[1])
    flat = flat @ turn
    book = centroids(bits, x.shape[1])
    code = np.searchsorted((book[1:] + book[:-1]) / 2, flat)
    left = flat - book[code]
    return radius, pack(code, bits), np.packbits(left @ rays.T >= 0, axis=1) if bits <= 4 else None, np.linalg.norm(left, axis=1)


def decode(radius: np.ndarray, packed: np.ndarray, bits: int, size: int) -> np.ndarray:
    turn, _ = projections(size)
    return radius[:, None] * (centroids(bits, size)[unpack(packed, bits, size)] @ turn.T)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=np.uint8) for x in column.to_pylist()])


def quantize(facts: DataFrame) -> DataFrame:
    """facts: (fact_id, vec, bits). (fact_id, radius, bits, codes, signs, rest, error): signs for 4 bits or fewer, rest the
    length of the residual, error that of a decoded unit vector. A zero vector has radius 0; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            for b in np.unique(bits).tolist():
                part = batch.filter(pa.array(bits == b))
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                radius, packed, signs, rest = encode(x, b)
                short = np.float32(np.float16(np.minimum(radius, 65504)))
                error = np.linalg.norm(decode(np.ones(len(x)), packed, b, x.shape[1]) - _unit(x)[0], axis=1)
                low = pa.nulls(len(x), pa.binary()) if signs is None else pa.array([s.tobytes() for s in signs], type=pa.binary())
                columns = [part.column("fact_id"), pa.array(short), pa.array(np.full(len(x), b, dtype=np.int32)), pa.array([p.tobytes() for p in packed], type=pa.binary()), low]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rest.astype(np.float32)), pa.array(error)], schema=CODES)

    return facts.where("vec IS NOT NULL").select("fact_id", "vec", "bits").mapInArrow(run, CODES_DDL)


def packed_similarity(asked: np.ndarray, packed: np.ndarray, bits: int, signs: np.ndarray | None, rest: np.ndarray) -> np.ndarray:
    """Cosine estimates, rows of unit queries against rows of codes: by centroids, and for the residual by its signs.

    The mean of (ray . query) * sign times sqrt(pi / 2) times the residual's length is what the residual adds.
    """
    turn, rays = projections(asked.shape[1])
    turned = asked @ turn
    found = turned @ centroids(bits, asked.shape[1])[unpack(packed, bits, asked.shape[1])].T
    if signs is not None:
        plus = np.unpackbits(signs, axis=1)[:, :LANES].astype(np.float64) * 2 - 1
        found += np.sqrt(np.pi / 2) / LANES * ((turned @ rays.T) @ plus.T) * rest
    return found


def packed_topk(queries: DataFrame, codes: DataFrame, k: int, most: int = BLOCK) -> DataFrame:
    """(query_id, fact_id, score): of each partition of `codes` the k facts most similar to each query.

    Queries are broadcast in blocks of at most `most`; codes are read as bytes and scored by matrix products.
    """
    spark, out = codes.sparkSession, None
    blocks = max(1, -(-queries.count() // most))
    for b in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", "vec").collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in rows]), _unit(np.array([r.vec for r in rows], dtype=np.float64))[0]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, asked = held.value
            s, f = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                width = batch.column("bits").to_numpy()
                for w in np.unique(width).tolist():
                    part = batch.filter(pa.array(width == w))
                    signs = _matrix(part.column("signs")) if w <= 4 else None
                    got = packed_similarity(asked, _matrix(part.column("codes")), w, signs, part.column("rest").to_numpy())
                    s, f = np.concatenate((s, got), axis=1), np.concatenate((f, np.broadcast_to(part.column("fact_id").to_numpy(), got.shape)), axis=1)
                order = np.lexsort((f, -s), axis=1)[:, :k]
                s, f = np.take_along_axis(s, order, 1), np.take_along_axis(f, order, 1)
            if s.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, s.shape[1])), pa.array(f.ravel()), pa.array(s.ravel())], names=["query_id", "fact_id", "score"])

        found = codes.select("fact_id", "bits", "codes", "signs", "rest").mapInArrow(run, "query_id long, fact_id long, score double")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, fact_id long, score double")


def coarse_topk(queries: DataFrame, facts: DataFrame, codes: DataFrame, k: int, again: int = 10) -> DataFrame:
    """(query_id, fact_id, score, rank): the k nearest, of which the `again` * k best by codes are compared exactly.

    Codes are a sixteenth or less of the vectors; only the vectors of a query's candidates are read for it.
    """
    near = best(packed_topk(queries, codes, again * k), again * k).select("query_id", "fact_id")
    met = near.join(facts.select("fact_id", "vec"), "fact_id").join(queries.select("query_id", F.col("vec").alias("asked")), "query_id")
    size = norm("vec") * norm("asked")
    return best(met.select("query_id", "fact_id", F.when(size > 0, dot("vec", "asked") / size).otherwise(0.0).alias("score")), k)


def mixed_search(queries: DataFrame, full: DataFrame, byte: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """(query_id, fact_id, score, rank) over three stored tiers: exact vectors, codes of 8 bits (0.98), packed codes (0.97).

    A fact in several tiers has its largest score. The k best of each tier hold the k best of all.
    """
    exact = topk(queries, full, k).select("query_id", "fact_id", (F.col("similarity") * FULL).alias("score"))
    found = exact.union(packed_topk(queries, byte, k).withColumn("score", F.col("score") * BYTE))
    found = found.union(packed_topk(queries, packed, k).withColumn("score", F.col("score") * PACKED))
    return best(found.groupBy("query_id", "fact_id").agg(F.max("score").alias("score")), k)


def tiers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Active facts as they are, warm ones in 8 bits, cold and archived ones in 4 and 2 unless they are forgotten."""
    vectors = views.vectors(spark, sf_dir).select("fact_id", "vec").join(views.facts(spark, sf_dir).select("fact_id", "lifecycle"), "fact_id")
    bits = F.when(F.col("lifecycle") == "warm", 8).when(F.col("lifecycle") == "cold", 4).otherwise(2)
    codes = quantize(vectors.where("lifecycle <> 'active'").withColumn("bits", bits))
    forgotten = _retention(spark, sf_dir).where("zone = 'forgotten'").select("fact_id")
    return vectors.where("lifecycle = 'active'"), codes.where("bits = 8"), codes.where("bits < 8").join(forgotten, "fact_id", "left_anti")


@query("V13_quantize_embeddings")
def v13_quantize_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at 4 bits a coordinate, with the error of decoding."""
    return quantize(views.vectors(spark, sf_dir).withColumn("bits", F.lit(4))).select("fact_id", "radius", "bits", "codes", "error")


@query("V14_qjl_residual")
def v14_qjl_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at two bits with the signs of their residuals."""
    return quantize(views.vectors(spark, sf_dir).withColumn("bits", F.lit(2)))


@query("V16_batch_compress")
def v16_batch_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that are not active, at 8 bits (warm), 4 (cold) or 2 (archived), with residual signs at 4 or fewer."""
    _, byte, packed = tiers(spark, sf_dir)
    return byte.union(packed)


@query("V15_mixed_precision_search")
def v15_mixed_precision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed_search(query_vectors(spark, sf_dir), *tiers(spark, sf_dir), 10)
    return found.select("query_id", "fact_id", F.round("score", 6).alias("similarity"), "rank")


@query("V3_cosine_topk_lsh")
def v3_cosine_topk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours: a hundred candidates a query by codes of two bits and signs, the ten best of them by cosine."""
    vectors = views.vectors(spark, sf_dir).select("fact_id", "vec")
    found = coarse_topk(query_vectors(spark, sf_dir), vectors, quantize(vectors.withColumn("bits", F.lit(2))), 10)
    return found.select("query_id", "fact_id", F.round("score", 6).alias("similarity"), "rank")
