"""K-d tree partitioning of documents into shards of near equal bytes.

Method: a k-d tree over metadata (source and lang by name, bytes, bytes a character, share of
spaces). Each node is split at the weighted median of its widest dimension, each dimension
measured by its range over the whole table. The medians come from sums of weights in bins
of the coordinate, refined bin by bin over the whole table until the bin holds one key:
exact, and only bin sums reach the driver. The text's hash only breaks ties.

Equal texts have one place: of several sources or langs the first by name counts. So they stay in one
shard, unless the cut falls among copies that weigh more than the tolerance; those are cut by doc_id.

Source and lang are coordinates by the rank of their name among all names, so any two names part.

Nulls: a null text has no bytes and size 1. Of a text, however long, only its size and hashes are exchanged. Repeated rows: each is placed. Ties: keys
alike in all coordinates are cut by text hash, then doc_id. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from ._common import numbered, stored

DIMENSIONS = ["d_source", "d_lang", "d_size", "d_density", "d_spaces"]
SALT = 32  # parts of a hot group of copies
TOLERANCE = 0.001  # what weighs less than this part of a shard, copies above all, is never parted
_BITS, _SPAN = 12, 48  # bins a round: 2**12; coordinates are integers below 2**48


def _coordinates(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    hashed = F.xxhash64(text)
    scale = F.lit(float(2**_SPAN - 1))
    unit = lambda c: (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * scale).cast("long")
    spaces = (F.length(text) - F.length(F.replace(text, F.lit(" ")))).cast("double")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), name("source").alias("source"), name("lang").alias("lang"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.crc32(F.encode(text, "UTF-8"))).cast("long").alias("text_crc32"),
        unit(F.log2(size.cast("double")) / 40).alias("d_size"),
        unit(F.length(text) / size).alias("d_density"),
        unit(spaces / size * 4).alias("d_spaces"),
        F.shiftrightunsigned(hashed, 64 - _SPAN).alias("d_hash"),
        hashed.alias("h"),
        F.shiftrightunsigned(F.xxhash64("doc_id", text), 64 - _SPAN).alias("tie"),
    )
    names = rows.groupBy("h").agg(F.min("source").alias("_s"), F.min("lang").alias("_l"), (F.max("source") != F.min("source")).alias("_a"), (F.max("lang") != F.min("lang")).alias("_b"))
    mixed = names.where("_a or _b").select("h", "_s", "_l", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    rows = rows.withColumn("_salt", F.pmod(F.col("tie"), F.lit(SALT)).cast("int")).join(mixed, ["h", "_salt"], "left")
    rows = rows.withColumn("source", F.coalesce("_s", "source")).withColumn("lang", F.coalesce("_l", "lang")).drop("_s", "_l", "_salt")
    rows = stored(rows, "named")
    for c in ("source", "lang"):
        order = ranked(rows.select(c, F.lit(0).alias("all")).distinct(), ["all"], [F.col(c)], "r", "n")
        step = F.floor(F.lit(2**_SPAN - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
        rows = rows.join(order.select(c, (F.col("r") * step).cast("long").alias(f"d_{c}")), c).drop(c)
    return rows


def _cut(rows: DataFrame, by: dict[int, str], total: dict[int, int], share: dict[int, float], light: dict[int, float]) -> dict[int, tuple[str, list[int]]]:
    """For each node the key (dimension value, hash, tie) below which about `share` of its weight lies."""
    found = {n: [] for n in by}
    want = {n: total[n] * share[n] for n in by}  # weight still to go left within the current bin
    done = set()
    for part in range(3):
        fixed = {n: 0 for n in by}
        for shift in range(_SPAN - _BITS, -1, -_BITS):
            keep, value = F.lit(False), F.lit(None).cast("long")
            for n in by.keys() - done:
                names = [by[n], "d_hash", "tie"]
                cond = (F.col("node") == n) & (F.shiftrightunsigned(F.col(names[part]), shift + _BITS) == fixed[n])
                for name, x in zip(names, found[n], strict=False):
                    cond = cond & (F.col(name) == x)
                keep, value = keep | cond, F.when(cond, F.shiftrightunsigned(F.col(names[part]), shift)).otherwise(value)
            if len(done) == len(by):
                break
            sums = rows.where(keep).groupBy("node", value.alias("bin")).agg(F.sum("size").alias("w")).collect()  # at most 2**_BITS bins a node
            for n in by.keys() - done:
                for bin_, w in sorted((r["bin"], r["w"]) for r in sums if r["node"] == n):
                    fixed[n] = bin_
                    if want[n] <= w:
                        break
                    want[n] -= w
                if w <= light[n]:  # too light to part: to the nearer side
                    done.add(n)
                    found[n] += [((fixed[n] + (2 * want[n] > w)) << shift) - 1] + [2**_SPAN] * (2 - part)
        for n in by.keys() - done:
            found[n].append(fixed[n])
    return {n: (by[n], found[n]) for n in by}


def kd_shards(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard 0 ... shards-1, of near equal sums of size; with target_bytes as many shards as that takes.

    `shards` leaves are made by splitting the heaviest share first at proportional
    medians, so any number works, not powers of two alone.
    """
    rows = stored(_coordinates(docs), "kd").withColumn("node", F.lit(0))
    if target_bytes is not None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    leaves, full = {0: (0, shards)}, None  # node: first shard, number of shards; ranges over the whole table
    while any(k > 1 for _, k in leaves.values()):
        todo = {n: v for n, v in leaves.items() if v[1] > 1}
        spread = [F.sum("size").alias("w")] + [(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(*spread).collect()}  # at most `shards` rows
        todo = {n: v for n, v in todo.items() if n in stats}
        for n in [n for n, v in leaves.items() if v[1] > 1 and n not in todo]:
            leaves[n] = (leaves[n][0], 1)  # an empty node: nothing to place
        if not todo:
            break
        full = full or {d: max(1, stats[0][d]) for d in DIMENSIONS}
        by = {n: max(DIMENSIONS, key=lambda d: stats[n][d] / full[d]) for n in todo}
        cuts = _cut(rows, by, {n: stats[n]["w"] for n in todo}, {n: (k // 2) / k for n, (_, k) in todo.items()}, {n: TOLERANCE * stats[n]["w"] / k for n, (_, k) in todo.items()})
        node = F.col("node")
        for n, (first, k) in todo.items():
            dim, (x, h, t) = cuts[n]
            a, b = max(leaves) + 1, max(leaves) + 2
            left = (F.col(dim) < x) | ((F.col(dim) == x) & ((F.col("d_hash") < h) | ((F.col("d_hash") == h) & (F.col("tie") <= t))))
            node = F.when(F.col("node") == n, F.when(left, F.lit(a)).otherwise(F.lit(b))).otherwise(node)
            del leaves[n]
            leaves |= {a: (first, k // 2), b: (first + k // 2, k - k // 2)}
        rows = stored(rows.withColumn("node", node), "kd")
    shard = F.lit(0)
    for n, (first, _) in leaves.items():
        shard = F.when(F.col("node") == n, F.lit(first)).otherwise(shard)
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """kd_shards with the law it follows and a gapless slot within each shard."""
    placed = stored(kd_shards(docs, shards), "placed")
    out = numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
