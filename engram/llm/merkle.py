"""Merkle manifest of a table with proofs that resume copied hash states (op13).

A row's leaf is the SHA-256 of its fields, a native expression. Leaves stand in order within their group; every `fan`
consecutive nodes become one, up to the group's subroot, and the subroots of all groups likewise become the root. Blocks of
`fan ** levels` consecutive nodes are folded in one task, then the blocks' nodes in blocks, until one node of each group is
left: a table of n leaves takes log(n) / log(fan ** levels) passes, of which all but the first read next to nothing.

While a block is built, each parent keeps a copy of its hash state before each child slot. A replaced child resumes the
state of its slot and adds itself and its right siblings only. Above its block, a node's path carries its left siblings,
from which the state before its slot is made once for the block, and its right siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engram.llm import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(fields: Sequence[Column]) -> Column:
    """SHA-256 as 32 bytes over each field in turn: `-` if null, else its UTF-8 bytes' number, `:` and the bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def depth(n: int, fan: int) -> int:
    """Levels above n nodes until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // fan), found + 1
    return found


class Block:
    """Consecutive nodes (hex text as bytes) and the levels above them, with each parent's states before its slots."""

    def __init__(self, nodes: list[bytes], fan: int, levels: int):
        self.fan, self.levels = fan, []
        for _ in range(levels):
            states, above = [], []
            for at in range(0, len(nodes), fan):
                state = hashlib.sha256()
                for node in nodes[at : at + fan]:
                    states.append(state.copy())
                    state.update(node)
                above.append(state.hexdigest().encode())
            self.levels.append((nodes, states))
            nodes = above
        self.top = nodes

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """Left and right siblings of the node at place `at` and of its ancestors, upwards, each joined."""
        found = []
        for nodes, _ in self.levels:
            first = at - at % self.fan
            found.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + self.fan])))
            at //= self.fan
        return found

    def fold(self, at: int, node: bytes, rights: list[bytes]) -> bytes:
        """The block's top with `node` at place `at`: resumes one state a level."""
        for (_, states), right in zip(self.levels, rights, strict=True):
            state = states[at].copy()
            state.update(node)
            state.update(right)
            node, at = state.hexdigest().encode(), at // self.fan
        return node


def _ordered(part: pa.Table) -> pa.Table:
    return part.take(pa.array(np.argsort(part.column("idx").to_numpy(), kind="stable")))


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _numbered(scratch: common.Scratch, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with idx, their gapless place within `grp` in the order of `keys`, and `total`, the group's number of rows.

    Rows that are equal in all keys are told apart by their place in the written table, so no range holds one key whole.
    """
    order = ["grp", *keys, "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    held = scratch.write(dealt.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    counts = held.groupBy("pid", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("grp").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("pid", "grp", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("grp")).alias("total"))
    return held.join(base, ["pid", "grp"]).withColumn("idx", F.col("at") + F.col("shift")).drop("pid", "at", "shift")


def _blocks(rows: DataFrame, size: int):
    return rows.withColumn("block", F.expr(f"idx div {size}L")).groupBy("grp", "block")


def _climb(scratch: common.Scratch, nodes: DataFrame, most: int, fan: int, levels: int, name: str) -> list[DataFrame]:
    """Tables of nodes (grp, idx, total, node): the given ones and those above each pass; the last has one of each group."""

    def up(key, part):
        part = _ordered(part)
        total = part.column("total")[0].as_py()
        height = min(levels, depth(total, fan))
        top = bytes.fromhex(Block(_hex(part.column("node")), fan, height).top[0].decode())
        return pa.table({"grp": [key[0].as_py()], "idx": [key[1].as_py()], "total": [-(-total // fan**height)], "node": [top]}, schema=schema)

    schema = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("total", pa.int64()), ("node", pa.binary())])
    found = [nodes]
    for k in range(-(-depth(most, fan) // levels)):
        found.append(scratch.write(_blocks(found[-1], fan**levels).applyInArrow(up, "grp string, idx long, total long, node binary"), f"{name}-{k}"))
    return found


PATH = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("lefts", pa.list_(pa.binary())), ("rights", pa.list_(pa.binary())), ("subroot", pa.binary()), ("root", pa.binary())])
PATH_DDL = "grp string, idx long, lefts array<binary>, rights array<binary>, subroot binary, root binary"


def _descend(passes: list[DataFrame], top: DataFrame, fan: int, levels: int) -> DataFrame:
    """Paths of the nodes of the first pass from those of the last one's; a path's siblings go upwards to the root."""

    def down(key, part, above):
        part, path = _ordered(part), above.to_pylist()[0]
        block = Block(_hex(part.column("node")), fan, min(levels, depth(part.column("total")[0].as_py(), fan)))
        found = [block.siblings(i) for i in range(part.num_rows)]
        lefts = [[left for left, _ in x] + path["lefts"] for x in found]
        rights = [[right for _, right in x] + path["rights"] for x in found]
        n = part.num_rows
        return pa.table({"grp": part.column("grp"), "idx": part.column("idx"), "lefts": lefts, "rights": rights, "subroot": [path["subroot"]] * n, "root": [path["root"]] * n}, schema=PATH)

    paths = top
    for nodes in reversed(passes[:-1]):
        paths = _blocks(nodes, fan**levels).cogroup(_named(paths).groupBy("grp", "block")).applyInArrow(down, PATH_DDL)
    return paths


def _named(paths: DataFrame) -> DataFrame:
    return paths.withColumnRenamed("idx", "block")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", presented: dict[str, Column] | None = None, fan: int = 8, levels: int = 3) -> DataFrame:
    """A row for each row of `docs`: order column, leaf, subroot, root, proof_sha256, folded_root, verified.

    `presented` maps fields to the columns that a holder of the row shows (default: the rows as they are): folded_root is
    the root that they give with the siblings of the original, verified whether it is the root. proof_sha256 is the hash
    of all siblings, upwards, left to right; of nothing for a lone row.

    Groups stand by their UTF-8 bytes, null first. Rows of a group stand by `order`, nulls first; rows that are equal in
    it by leaf, and equal leaves are interchangeable. Repeated rows are leaves each for itself, null and empty values
    differ, other columns are not read, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "merkle")
    named = {x: docs[x] for x in fields}
    shown = leaf([(presented or {}).get(x, named[x]) for x in fields])
    rows = docs.select(F.coalesce(F.concat(F.lit("v"), docs[group].cast("string")), F.lit("n")).alias("grp"), docs[order].alias("id"), leaf(list(named.values())).alias("node"), shown.alias("shown"))
    # The written leaves are what range limits are sampled from, so texts are read once.
    rows = scratch.write(rows, "leaves")
    leaves = _numbered(scratch, rows, ["id", "node"], "ordered")
    most = leaves.agg(F.max("total")).first()[0] or 0
    below = _climb(scratch, leaves.select("grp", "idx", "total", "node"), most, fan, levels, "nodes")
    subroots = below[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("node"))
    subroots = scratch.write(_numbered(scratch, subroots, ["of"], "groups"), "subroots")
    above = _climb(scratch, subroots.select("grp", "idx", "total", "node"), subroots.count(), fan, levels, "top")
    none = F.array().cast("array<binary>")
    top = above[-1].select("grp", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("binary").alias("subroot"), F.col("node").alias("root"))
    group_paths = _descend(above, top, fan, levels).join(subroots.select("idx", "of", "node"), "idx")
    group_paths = group_paths.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("node").alias("subroot"), "root")
    paths = scratch.write(group_paths, "group-paths")
    if len(below) > 1:
        paths = scratch.write(_descend(below[1:], paths, fan, levels), "paths")

    def prove(key, part, above):
        part, path = _ordered(part), above.to_pylist()[0]
        nodes, shown = _hex(part.column("node")), _hex(part.column("shown"))
        block = Block(nodes, fan, min(levels, depth(part.column("total")[0].as_py(), fan)))
        rest = b"".join(x for pair in zip(path["lefts"], path["rights"], strict=True) for x in pair)
        before = [hashlib.sha256(left) for left in path["lefts"]]
        proofs, folded = [], []
        for i, node in enumerate(shown):
            siblings = block.siblings(i)
            proofs.append(hashlib.sha256(b"".join(left + right for left, right in siblings) + rest).hexdigest())
            at = block.fold(i, node, [right for _, right in siblings])
            for state, right in zip(before, path["rights"], strict=True):
                state = state.copy()
                state.update(at)
                state.update(right)
                at = state.hexdigest().encode()
            folded.append(at.decode())
        n, root = part.num_rows, path["root"].hex()
        columns = [part.column("id"), [x.decode() for x in nodes], [path["subroot"].hex()] * n, [root] * n, proofs, folded, [x == root for x in folded]]
        return pa.table(columns, names=[order, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = dict(docs.select(docs[order]).dtypes)[order]
    schema = f"`{order}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _blocks(leaves, fan**levels).cogroup(_named(paths).groupBy("grp", "block")).applyInArrow(prove, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`; where 3 divides the CRC of the doc_id, the text is shown with its A-Z in lower case. Nulls as in `manifest`."""
    docs = common.read(spark, sf_dir, "documents")
    changed = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    text = F.when(changed, F.translate(docs["text"], UPPER, LOWER)).otherwise(docs["text"])
    return manifest(docs, presented={"text": text})


#: Trees level by level in recursion; CRC-32 bit by bit; each row is folded with all its siblings.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, coalesce('v' || lang, 'n') AS g,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM documents),
e AS (SELECT *, coalesce(xor(c, 4294967295) % 3 = 0, false) AS changed,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
l AS (SELECT r, g, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(text) || ':' || CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS shown FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (SELECT g, 0 AS lev, i, leaf AS h FROM n UNION ALL
  SELECT g, lev + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS k FROM t) WHERE k > 1 GROUP BY g, lev + 1, i // 8),
dep AS (SELECT g, max(lev) AS top FROM t GROUP BY g), s AS (SELECT t.g, t.h AS subroot, row_number() OVER (ORDER BY t.g) - 1 AS j FROM t JOIN dep ON t.g = dep.g AND t.lev = dep.top),
u AS (SELECT 0 AS lev, j, subroot AS h FROM s UNION ALL
  SELECT lev + 1, j // 8, sha256(string_agg(h, '' ORDER BY j)) FROM (SELECT *, count(*) OVER () AS k FROM u) WHERE k > 1 GROUP BY lev + 1, j // 8),
udep AS (SELECT max(lev) AS top FROM u), root AS (SELECT h AS root FROM u JOIN udep ON lev = top),
f AS (SELECT r, g, 0 AS lev, i, shown AS h, ''::VARCHAR AS sib FROM n UNION ALL
  SELECT f.r, f.g, f.lev + 1, f.i // 8, sha256(string_agg(CASE WHEN t.i = f.i THEN f.h ELSE t.h END, '' ORDER BY t.i)), any_value(f.sib) || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> f.i), '')
  FROM f JOIN dep ON dep.g = f.g AND f.lev < dep.top JOIN t ON t.g = f.g AND t.lev = f.lev AND t.i // 8 = f.i // 8 GROUP BY f.r, f.g, f.lev, f.i),
f2 AS (SELECT f.r, s.subroot, s.j, f.h, f.sib FROM f JOIN dep ON dep.g = f.g AND f.lev = dep.top JOIN s ON s.g = f.g),
q AS (SELECT r, 0 AS lev, j, h, sib FROM f2 UNION ALL
  SELECT q.r, q.lev + 1, q.j // 8, sha256(string_agg(CASE WHEN u.j = q.j THEN q.h ELSE u.h END, '' ORDER BY u.j)), any_value(q.sib) || coalesce(string_agg(u.h, '' ORDER BY u.j) FILTER (u.j <> q.j), '')
  FROM q JOIN udep ON q.lev < udep.top JOIN u ON u.lev = q.lev AND u.j // 8 = q.j // 8 GROUP BY q.r, q.lev, q.j)
SELECT n.doc_id, n.leaf, f2.subroot, root.root, sha256(q.sib) AS proof_sha256, q.h AS folded_root, q.h = root.root AS verified
FROM n JOIN f2 ON f2.r = n.r JOIN q ON q.r = n.r JOIN udep ON q.lev = udep.top CROSS JOIN root
"""
