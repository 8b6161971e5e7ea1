"""Merkle manifest of a dataset: a tree of SHA-256 whose parents keep the hash state before each child.

A leaf is the hash of a row's fields, each as its UTF-8 length, a colon and the value, or `-`
where it is null. Leaves of a group ascend by the key; every `fan` consecutive nodes (the last
run: fewer, even one) become the hash of their digests as hex text, level by level,
until one remains: the group's subroot. Subroots, ordered by group (null first), likewise give the root.

A digest as hex text is one 64-byte block of SHA-256, so the state before each child slot is a
chaining value of eight words: it is kept with the parent, in a table, and hashing goes on from
it in any task. `fold` takes replaced leaves: at each parent it resumes the state before the
child's slot with the replacement and the right siblings only, never reading the left ones.
`compress` is SHA-256's step for many nodes at once in numpy.

On Spark: leaves get gapless numbers by ranges (ranking.ranked) and go in blocks of `fan ** height`
to tasks, which build the block's tree; the tops of blocks are the leaves of the next round, a
4096th as many. So no task sees a whole group, however large, and nothing passes through the driver but the
number of rounds. A block's tree is one row (about 100 bytes a leaf).

Nulls: a null field is `-`; a null group is a group of its own, before all others; rows with a null key come first
in their group. Ties of the key are ordered by their leaf; rows alike in all fields swap places freely,
as their leaves are the same. Empty texts are `0:`; texts of any length are hashed whole by the JVM.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ..storage import stored
from ._bytes import give_back, unpacked

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN, HEIGHT = 2, 12


# --- SHA-256 over many nodes at once -----------------------------------------


def _roots(power: int, n: int) -> np.ndarray:
    """The first 32 bits of the fractional parts of the square or cube roots of the first n primes."""
    primes = [p for p in range(2, 330) if all(p % q for q in range(2, int(p**0.5) + 1))][:n]
    out = []
    for p in primes:
        low, high = 0, 1 << 40
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**power <= p << (32 * power) else (low, mid)
        out.append(low & 0xFFFFFFFF)
    return np.array(out, np.uint32)


START, ROUND = _roots(2, 8), _roots(3, 64)
_HEX = np.frombuffer("".join(f"{i:04x}" for i in range(1 << 16)).encode(), ">u4").astype(np.uint32)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after blocks of 16 words (n, 16)."""
    w = list(np.ascontiguousarray(block.T))
    first = list(np.ascontiguousarray(state.T))
    a, b, c, d, e, f, g, h = first
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ x >> np.uint32(3)) + w[i - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ y >> np.uint32(10)))
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ e & (f ^ g)) + ROUND[i] + w[i]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + (a & b | c & (a | b))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([x + y for x, y in zip(first, (a, b, c, d, e, f, g, h), strict=True)], 1)


def absorb(state: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """States (n, 8) after one digest (n, 8) more, as hex text: one block each."""
    if not len(state):
        return state
    words = np.empty((len(digest), 16), np.uint32)
    words[:, 0::2], words[:, 1::2] = _HEX[digest >> np.uint32(16)], _HEX[digest & np.uint32(0xFFFF)]
    return compress(state, words)


def finish(state: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Digests of messages of `count` blocks."""
    end = np.zeros((len(state), 16), np.uint32)
    end[:, 0], end[:, 15] = 1 << 31, count * 512
    return compress(state, end)


def fresh(n: int) -> np.ndarray:
    return np.repeat(START[None], n, 0)


# --- trees ---------------------------------------------------------------------


class Level(NamedTuple):
    """Nodes of a level, and for each of their parents the state before each child slot."""

    nodes: np.ndarray  # (n, 8)
    states: np.ndarray  # (parents, fan, 8)


def levels(n: int, fan: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // fan), out + 1
    return out


def grow(nodes: np.ndarray, fan: int, most: int) -> tuple[list[Level], np.ndarray]:
    """`most` levels above the nodes, and what remains."""
    out = []
    for _ in range(most):
        parents = -(-len(nodes) // fan)
        size = np.minimum(fan, len(nodes) - fan * np.arange(parents))
        states = np.zeros((parents, fan, 8), np.uint32)
        state = fresh(parents)
        for k in range(fan):
            states[:, k] = state
            has = size > k
            state[has] = absorb(state[has], nodes[k::fan])
        out.append(Level(nodes, states))
        nodes = finish(state, size)
    return out, nodes


def climb(level: Level, at: np.ndarray, digest: np.ndarray, proof: np.ndarray, count: np.ndarray) -> tuple:
    """One level up, for children `at` replaced by `digest`: the parents' numbers, their digests, and the proof with the children's siblings.

    A parent's hash goes on from the state before the slot; the left siblings are read for the proof alone.
    """
    nodes, states = level
    fan = states.shape[1]
    parent, slot = at // fan, at % fan
    size = np.minimum(fan, len(nodes) - parent * fan)
    state = absorb(states[parent, slot], digest)
    for k in range(fan):
        beside = (k < size) & (k != slot)
        sibling = nodes[(parent * fan + k)[beside]]
        proof[beside] = absorb(proof[beside], sibling)
        right = k > slot[beside]
        on = np.flatnonzero(beside)[right]
        state[on] = absorb(state[on], sibling[right])
    return parent, finish(state, size), proof, count + size - 1


def pack(tree: list[Level]) -> bytes:
    return b"".join(x.astype("<u4").tobytes() for level in tree for x in level)


def unpack(raw: bytes, n: int, fan: int, most: int) -> list[Level]:
    words, at, out = np.frombuffer(raw, "<u4").astype(np.uint32).reshape(-1, 8), 0, []
    for _ in range(most):
        parents = -(-n // fan)
        out.append(Level(words[at : at + n], words[at + n : at + n + parents * fan].reshape(parents, fan, 8)))
        at, n = at + n + parents * fan, parents
    return out


def families(tree: list[Level], at: int, fan: int) -> bytes:
    """The way up from a node: at each level its slot, the family's size, the family, and the parent's states."""
    out = []
    for nodes, states in tree:
        parent = at // fan
        own = nodes[parent * fan : (parent + 1) * fan]
        out.append(np.concatenate([np.array([at % fan, len(own)], "<u4"), own.ravel(), states[parent].ravel()]).astype("<u4").tobytes())
        at = parent
    return b"".join(out)


def way(raw: bytes, fan: int) -> list[tuple[int, Level]]:
    words, at, out = np.frombuffer(raw, "<u4").astype(np.uint32), 0, []
    while at < len(words):
        slot, size = int(words[at]), int(words[at + 1])
        end = at + 2 + 8 * size
        out.append((slot, Level(words[at + 2 : end].reshape(size, 8), words[end : end + 8 * fan].reshape(1, fan, 8))))
        at = end + 8 * fan
    return out


# --- on Spark --------------------------------------------------------------------


class Manifest(NamedTuple):
    """leaves: g, idx, block, key, leaf; trees: g, block, n, tree, path, subroot, root, a row for each block."""

    leaves: DataFrame
    trees: DataFrame
    fan: int
    height: int


def leaf(fields: list[Column]) -> Column:
    """The hash of a row's fields, as bytes."""

    def one(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[one(c) for c in fields]), 256))


def group_key(group: Column) -> Column:
    """A group as text that sorts as the group does, bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def _digests(table: pa.Table, name: str) -> np.ndarray:
    return unpacked(table, name, ">u4").astype(np.uint32).reshape(-1, 8)


def _bytes_of(digest: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in digest.astype(">u4")], pa.binary())


def _round(nodes: DataFrame, fan: int, height: int, ways: bool) -> DataFrame:
    """g, block, n (of the group), top and the tree of each block; ways: a row for each node instead, with its number and its way up."""
    span = fan**height

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        total, base = table.column("n")[0].as_py(), key[1].as_py() * span
        tree, top = grow(_digests(table, "digest"), fan, min(height, levels(total, fan)))
        n = len(table) if ways else 1
        cols = {"g": [key[0].as_py()] * n, "block": [key[1].as_py()] * n, "n": [total] * n, "top": _bytes_of(np.repeat(top, n, 0))}
        more = {"idx": [base + i for i in range(n)], "way": [families(tree, i, fan) for i in range(n)]} if ways else {"size": [len(table)], "tree": [pack(tree)]}
        out = pa.table(cols | more)
        del table, tree
        give_back()
        return out

    schema = "g string, block long, n long, top binary, " + ("idx long, way binary" if ways else "size long, tree binary")
    parts = nodes.select("g", F.floor(F.col("idx") / span).cast("long").alias("block"), "idx", "n", "digest")
    return parts.groupBy("g", "block").applyInArrow(work, schema)


def _up(tops: DataFrame, fan: int, height: int, name: str) -> DataFrame:
    """g, idx, way, top for nodes (g, idx, n, digest): rounds of blocks until each group has one node."""
    out, span = None, fan**height
    while True:
        done = stored(_round(tops, fan, height, True), name)
        step = done.select("g", "idx", "block", "way", "top")
        if out is None:
            out = step.withColumnRenamed("block", "at")
        else:
            nxt = step.select("g", F.col("idx").alias("at"), F.col("block").alias("b"), F.col("way").alias("w"), F.col("top").alias("t"))
            out = out.drop("top").join(nxt, ["g", "at"]).select("g", "idx", F.col("b").alias("at"), F.concat("way", "w").alias("way"), F.col("t").alias("top"))
        if (done.agg(F.max("n")).first()[0] or 0) <= span:
            return out.drop("at")
        ceil = F.ceil(F.col("n") / span).cast("long")
        tops = done.where(F.col("idx") == F.col("block") * span).select("g", F.col("block").alias("idx"), ceil.alias("n"), F.col("top").alias("digest"))


def manifest(docs: DataFrame, fields: list[str] | None = None, key: str = "doc_id", group: str = "lang", fan: int = FAN, height: int = HEIGHT, tampered: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. tampered: fields as they are found later; leaves then also have `found`, the leaf over them."""
    names, later = fields or FIELDS, tampered or {}
    read = [F.col(c) for c in names]
    rows = docs.select(group_key(F.col(group)).alias("g"), F.col(key).alias("key"), leaf(read).alias("leaf"), leaf([later.get(c, F.col(c)) for c in names]).alias("found"))
    span = fan**height
    leaves = ranked(stored(rows, "leaves"), ["g"], [F.col("key").asc_nulls_first(), F.col("leaf")], "idx", "n")
    leaves = stored(leaves.withColumn("block", F.floor(F.col("idx") / span).cast("long")), "numbered")
    trees = stored(_round(leaves.withColumnRenamed("leaf", "digest"), fan, height, False), "trees")
    ceil = F.ceil(F.col("n") / span).cast("long")
    sub = stored(_up(trees.select("g", F.col("block").alias("idx"), ceil.alias("n"), F.col("top").alias("digest")), fan, height, "tops"), "subroots")
    roots = sub.where("idx = 0").select("g", F.col("top").alias("digest"))
    roots = ranked(roots.withColumn("_all", F.lit("")), ["_all"], [F.col("g")], "idx", "n")
    last = _up(roots.select(F.col("_all").alias("g"), "idx", "n", "digest"), fan, height, "roots").select("idx", F.col("way").alias("last"), F.col("top").alias("root"))
    last = roots.join(last, "idx").select("g", "last", "root")
    ways = sub.select("g", F.col("idx").alias("block"), "way", F.col("top").alias("subroot")).join(last, "g")
    ways = ways.select("g", "block", F.concat("way", "last").alias("path"), "subroot", "root")
    return Manifest(leaves, stored(trees.select("g", "block", "n", "size", "tree").join(ways, ["g", "block"]), "manifest"), fan, height)


def fold(made: Manifest, replaced: DataFrame) -> DataFrame:
    """For rows (g, block, idx, key, leaf, found): what the root becomes if `found` stands for that leaf, and the hash of its proof.

    key, leaf, subroot, root, proof_sha256, folded_root (all but the key as bytes). Rows of a block and the block's tree meet in one task.
    """
    fan, height = made.fan, made.height
    kind = replaced.schema["key"].dataType.simpleString()

    def work(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
        if not len(rows) or not len(trees):
            return rows.select(["key", "leaf"]).slice(0, 0).append_column("subroot", pa.array([], pa.binary())).append_column("root", pa.array([], pa.binary())).append_column("proof_sha256", pa.array([], pa.binary())).append_column("folded_root", pa.array([], pa.binary()))
        total, size = trees.column("n")[0].as_py(), trees.column("size")[0].as_py()
        tree = unpack(trees.column("tree")[0].as_py(), size, fan, min(height, levels(total, fan)))
        up = way(trees.column("path")[0].as_py(), fan)
        out = []
        for a in range(0, len(rows), 4096):
            part = rows.slice(a, 4096)
            at = part.column("idx").to_numpy() - key[1].as_py() * fan**height
            digest, proof, count = _digests(part, "found"), fresh(len(part)), np.zeros(len(part), np.int64)
            for level in tree:
                at, digest, proof, count = climb(level, at, digest, proof, count)
            for slot, level in up:
                _, digest, proof, count = climb(level, np.full(len(part), slot), digest, proof, count)
            same = [pa.array([trees.column(c)[0].as_py()] * len(part), pa.binary()) for c in ("subroot", "root")]
            out.append(pa.table([part.column("key"), part.column("leaf"), *same, _bytes_of(finish(proof, count)), _bytes_of(digest)], names))
        give_back()
        return pa.concat_tables(out)

    left = replaced.select("g", "block", "idx", "key", "leaf", "found").groupBy("g", "block")
    return left.cogroup(made.trees.groupBy("g", "block")).applyInArrow(work, f"key {kind}, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary")


def verified(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Where 7 divides crc32(doc_id), the row is found tampered with: one more in n_chars.
    """
    bad = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, F.lit(False))
    made = manifest(docs, tampered={"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    out = fold(made, made.leaves)
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return out.select(F.col("key").alias("doc_id"), *hexed, (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT)"""
_PLAIN = [_FIELD.format(c) for c in FIELDS]
_BAD = [*_PLAIN[:3], _FIELD.format(f"(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)"), _PLAIN[4]]
ORACLE = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '-') AS k, sha256({' || '.join(_PLAIN)}) AS leaf, sha256({' || '.join(_BAD)}) AS found FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM d),
t AS (SELECT k, 0 AS lvl, idx, leaf AS h, n FROM r
  UNION ALL SELECT k, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM t WHERE n > 1 GROUP BY k, lvl, idx // 2),
s AS (SELECT k, h AS subroot, lvl AS top, row_number() OVER (ORDER BY encode(k)) - 1 AS g, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, g AS idx, subroot AS h, n FROM s
  UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2) FROM u WHERE n > 1 GROUP BY lvl, idx // 2),
root AS (SELECT h AS root, lvl AS last FROM u WHERE n = 1),
x AS (SELECT k, lvl, idx, h FROM t WHERE n > 1 UNION ALL SELECT s.k, s.top + u.lvl, u.idx, u.h FROM u, s),
w AS (SELECT doc_id, leaf, found AS cur, '' AS proof, CASE WHEN top = 0 THEN g ELSE idx END AS idx, k, subroot, g, top, root, top + last AS last, 0 AS lvl FROM r JOIN s USING (k) CROSS JOIN root
  UNION ALL SELECT doc_id, leaf, sha256(CASE WHEN x.h IS NULL THEN cur WHEN w.idx % 2 = 0 THEN cur || x.h ELSE x.h || cur END), proof || coalesce(x.h, ''),
    CASE WHEN w.lvl + 1 = top THEN g ELSE w.idx // 2 END, w.k, subroot, g, top, root, last, w.lvl + 1
  FROM w LEFT JOIN x ON x.k = w.k AND x.lvl = w.lvl AND x.idx = xor(w.idx, 1) WHERE w.lvl < last)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM w WHERE lvl = last"""
