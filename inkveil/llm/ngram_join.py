"""Exact Jaccard self-join of documents on word n-grams, and its connected components.

Method: rare-first prefix filtering. Every document is the set of its distinct 5-word
shingles (64-bit hashes). The document frequency of each shingle is counted over the
whole corpus, with copies counted once; a set is ordered from rare to frequent. Shingles
that a sample shows to be in very many documents are not counted: they come last, by
their number in the sample, and are dealt by document instead of by shingle, so that no
task gets all occurrences of one. Any order that all sets share gives the same links. Two
sets with similarity >= t must share a shingle within their prefixes of
n - ceil(t n) + 1 shingles. As shingles of frequency 1 come first and match nothing, a
set reaches the join only if most of its shingles occur elsewhere, and then only
its shared shingles travel.

Documents that share a prefix shingle (directly or through others) form a block; a
block goes to one task, or, if it is large, to one task for each pair of its chunks,
so no group of copies, however large, lands in one place. Inside, candidates come from
an inverted index over prefixes with length, positional and suffix filters, and each pair
is verified once, by counting common shingles. Pairs never leave the task: each set
reports its root, and the number of documents that it is linked with.

Equal sets are one class from the start. Shingles and classes are told apart by 64-bit
hashes. Nulls and texts without words have no shingles and no links; fewer than n words
are one shingle. A text is read whole, in slices of rows, a long one alone. Repeated rows and ties are one class each. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import unused
from ._bytes import give_back, mix, shingle_sets, slices
from ._common import components, passing, stored, texts

#: Shingles for each task that counts frequencies; classes for each task that verifies.
BUCKET_SHINGLES, CHUNK = 2_000_000, 4096
#: Texts of the sample for frequent shingles, at least this many and this share of all; texts of it that make a shingle frequent.
SAMPLE, SAMPLE_SHARE, FREQUENT = 4096, 2.5e-6, 20
_OFTEN = 1 << 30  # above any counted frequency: a task that counts has fewer shingles


def _signature(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    x = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))) ^ (np.add.reduce(mix(s)) * np.uint64(3)) + np.uint64(len(s))
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, sig (null without shingles) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, sigs = [], []
            for _, _, data, off in slices(batch, "text"):
                for s in shingle_sets(data, off, k):
                    ns.append(len(s))
                    sigs.append(_signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64())], ["doc_id", "n_shingles", "sig"])

    return texts(docs).mapInArrow(work, "doc_id long, n_shingles long, sig long")


def _frequent(docs: DataFrame, k: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in ascending order, and their numbers of different texts in the sample.

    At most SAMPLE or SAMPLE_SHARE of the texts, and of their shingles at most one for FREQUENT of them, come to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in slices(batch, "text"):
                for s in shingle_sets(data, off, k):
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), _signature(s))), pa.array(s.view(np.int64))], ["sig", "h"])

    share = min(1.0, max(SAMPLE / max(1, total), SAMPLE_SHARE))
    sample = texts(docs).select("text")
    sample = sample.sample(share, seed=7) if share < 1 else sample
    found = sample.mapInArrow(work, "sig long, h long").distinct().groupBy("h").count().where(F.col("count") >= FREQUENT).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _place(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value would stand in an ascending array, and whether it is there."""
    at = np.searchsorted(among, values)
    return at, np.r_[among, np.uint64(0)][at] == values if len(among) else np.zeros(len(values), bool)


def _range(x: np.ndarray, parts: int) -> np.ndarray:
    """The part, of equal ranges of 64-bit hashes, that each is in."""
    return ((x.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _dealt(docs: DataFrame, k: int, buckets: int, frequent) -> DataFrame:
    """Shingles by ranges of their hash: bucket, sigs (8 bytes each), ns and counts (4 each), hashes (8 each, by sig).

    Frequent ones, a broadcast, are in as many buckets more, by ranges of sig.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
            sigs = np.array(list(sets), np.int64)
            sizes = np.array([len(s) for s in sets.values()])
            h = np.concatenate(list(sets.values()))
            doc = np.repeat(np.arange(len(sigs), dtype=np.int64), sizes)
            _, often = _place(h, frequent.value[0])
            to = np.where(often, buckets + np.repeat(_range(sigs, buckets), sizes), _range(h, buckets))
            key = to * len(sigs) + doc
            order = np.argsort(key, kind="stable")
            key, h = key[order], h[order]
            first = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]  # one for each bucket and class
            counts = np.diff(first).astype("<u4")
            bucket, doc = np.divmod(key[first[:-1]], len(sigs))
            own, n = sigs[doc], sizes[doc].astype("<u4")
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist()
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out.append((bucket[a], own[a:b].tobytes(), n[a:b].tobytes(), counts[a:b].tobytes(), h[first[a] : first[b]].tobytes()))
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "sigs", "ns", "counts", "hashes"])

        sets, size = {}, 0
        for batch in batches:
            for _, _, data, off in slices(batch, "text"):
                for s in shingle_sets(data, off, k):
                    if len(s) and (sig := _signature(s)) not in sets:
                        sets[sig] = s
                        size += len(s)
                        if size > 1_500_000:
                            yield rows(sets)
                            sets, size = {}, 0
        if sets:
            yield rows(sets)
        sets = {}
        give_back()

    return texts(docs).select("text").mapInArrow(work, "bucket int, sigs binary, ns binary, counts binary, hashes binary")


def _shared(dealt: DataFrame, parts: int, frequent) -> DataFrame:
    """Shingles that several classes have, by ranges of the class: part, sigs, ns, counts, hashes, dfs (packed).

    Frequent ones count as shared.
    """

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf.pop("hashes")), "<u8")
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4")
        sig = np.repeat(np.frombuffer(b"".join(pdf["sigs"]), "<i8"), counts)
        n = np.repeat(np.frombuffer(b"".join(pdf["ns"]), "<u4"), counts)
        often = key[0] >= parts
        order = np.argsort(h, kind="stable")
        hs = h[order]
        again = np.full(len(hs), often)
        eq = hs[1:] == hs[:-1]
        again[1:] |= eq
        again[:-1] |= eq
        order = order[again]
        order = order[np.lexsort((h[order], sig[order]))]
        hs, sg, n = h[order], sig[order], n[order]
        new = np.ones(len(hs), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (sg[1:] != sg[:-1])  # the same class from several batches
        hs, sg, n = hs[new], sg[new], n[new]
        if often:
            df = _OFTEN + frequent.value[1][_place(hs, frequent.value[0])[0]]
        else:
            _, back, df = np.unique(hs, return_inverse=True, return_counts=True)
            df = df[back]
            del back
        keep = df > 1
        hs, sg, n, df = hs[keep], sg[keep], n[keep], df[keep].astype("<i4")
        start = np.flatnonzero(np.r_[True, sg[1:] != sg[:-1]]) if len(sg) else np.zeros(0, int)
        many = np.diff(np.r_[start, len(sg)]).astype("<u4")
        to = _range(sg[start], parts)
        out = []
        for p in np.unique(to).tolist():
            classes = to == p
            rows = np.repeat(classes, many)
            out.append((p, sg[start][classes].tobytes(), n[start][classes].tobytes(), many[classes].tobytes(), hs[rows].tobytes(), df[rows].tobytes()))
        del h, hs, sg, n, df, order, sig, counts
        give_back()
        return pd.DataFrame(out, columns=["part", "sigs", "ns", "counts", "hashes", "dfs"])

    return dealt.groupBy("bucket").applyInPandas(work, "part int, sigs binary, ns binary, counts binary, hashes binary, dfs binary")


def needed(n, num: int = 3, den: int = 4):
    """ceil(t n)."""
    return -(-n * num // den)


def _ordered(shared: DataFrame, num: int, den: int) -> DataFrame:
    """sig, n, ids (shared shingles, rare first), unique (number of those before them), prefix (ids that count as prefix).

    Only classes of which a shared shingle lies in the prefix.
    """

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.frombuffer(b"".join(pdf["counts"]), "<u4")
        sig = np.repeat(np.frombuffer(b"".join(pdf["sigs"]), "<i8"), counts)
        n = np.repeat(np.frombuffer(b"".join(pdf["ns"]), "<u4"), counts).astype(np.int64)
        h, d = np.frombuffer(b"".join(pdf["hashes"]), "<u8"), np.frombuffer(b"".join(pdf["dfs"]), "<i4")
        order = np.lexsort((h, d, sig))
        sig, n, h = sig[order], n[order], h[order]
        cuts = np.r_[np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]), len(sig)]
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            size = int(n[a])
            prefix = b - a - int(needed(size, num, den)) + 1
            if prefix > 0:
                out.append((int(sig[a]), size, h[a:b].tobytes(), size - (b - a), h[a : a + prefix].view(np.int64)))
        give_back()
        return pd.DataFrame(out, columns=["sig", "n", "ids", "unique", "prefix"])

    return shared.groupBy("part").applyInPandas(work, "sig long, n long, ids binary, unique long, prefix array<long>")


def verify_block(n: list[int], copies: list[int], ids: list[np.ndarray], unique: list[int], num: int, den: int, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Root of each member and the number of documents linked with it.

    Sets are taken by length; candidates of each come from the prefixes of those before.
    half: where given, only pairs of one member before and one from this index on.
    """
    size = len(n)
    root, links = np.arange(size), np.zeros(size, np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ns, uniq, cp = np.array(n), np.array(unique), np.array(copies)
    side = np.arange(size) >= (half or 0)
    cells = np.stack([np.bincount((x >> np.uint64(60)).astype(np.int64), minlength=16) for x in ids])
    order = np.lexsort((np.arange(size), ns))
    prefix: dict[int, list[tuple[int, int]]] = {}
    members = {i: set(ids[i].tolist()) for i in range(size)} if size <= 64 else None
    values = None
    if members is None:  # ids as dense numbers, and the sets that have each
        values, flat = np.unique(np.concatenate(ids), return_inverse=True)
        dense = np.split(flat, np.cumsum([len(x) for x in ids])[:-1])
        by = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(size), [len(x) for x in ids])[by]
        at = np.searchsorted(flat[by], np.arange(len(values) + 1))
    for i in order.tolist():
        a = int(ns[i])
        p = a - int(needed(a, num, den)) + 1 - int(uniq[i])
        best: dict[int, int] = {}
        for pos, h in enumerate(ids[i][: max(0, p)].tolist()):
            mine = prefix.setdefault(h, [])
            for j, other in mine:
                if j not in best:  # positional filter: what can follow the first common shingle
                    best[j] = 1 + min(len(ids[i]) - pos - 1, len(ids[j]) - other - 1)
            mine.append((i, pos))
        if not best:
            continue
        js = np.fromiter(best, np.int64, len(best))
        most = np.fromiter(best.values(), np.int64, len(best))
        least = -(-(a + ns[js]) * num // (num + den))  # overlap that the similarity needs
        ok = (ns[js] * den >= a * num) & (most >= least)
        if half is not None:
            ok &= side[js] != side[i]
        js, least = js[ok], least[ok]
        ok = np.minimum(cells[js], cells[i]).sum(1) >= least  # suffix filter over ranges of the hash
        js, least = js[ok], least[ok]
        if not len(js):
            continue
        if members is not None:
            common = np.array([len(members[i] & members[j]) for j in js.tolist()])
        else:
            common = np.bincount(np.concatenate([owner[at[v] : at[v + 1]] for v in dense[i].tolist()]), minlength=size)[js]
        for j in js[common * den >= num * (a + ns[js] - common)].tolist():
            links[i] += cp[j]
            links[j] += cp[i]
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(size)], np.int64), links


def _verified(members: DataFrame, num: int, den: int) -> DataFrame:
    """sig, root, links for each member of each (block, chunk pair)."""

    def work(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["block", "ci", "cj"], sort=False):
            g = g.sort_values(["chunk", "sig"])
            half = int((g["chunk"] == g["ci"]).sum()) if g["ci"].iloc[0] != g["cj"].iloc[0] else None
            sig = g["sig"].to_numpy()
            root, links = verify_block(g["n"].tolist(), g["copies"].tolist(), [np.frombuffer(x, "<u8") for x in g["ids"]], g["unique"].tolist(), num, den, half)
            out.append(pd.DataFrame({"sig": sig, "root": sig[root], "links": links}))
        return pd.concat(out) if out else pd.DataFrame({"sig": [], "root": [], "links": []})

    return members.groupBy("task").applyInPandas(work, "sig long, root long, links long")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row; linked: similarity >= num / den."""
    rows = stored(_classes(docs, k), "classes")
    cls = stored(rows.where("sig is not null").groupBy("sig").agg(F.max("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("doc")), "sets")
    total, copies = (x or 0 for x in cls.agg(F.sum("n"), F.sum("copies")).first())
    buckets = max(8, -(-total // BUCKET_SHINGLES))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k, copies))
    with passing(_ordered(_shared(_dealt(docs, k, buckets, frequent), buckets, frequent), num, den), "prefixes") as sets:
        posts = sets.select("sig", F.explode("prefix").alias("h"))
        first = posts.groupBy("h").agg(F.min("sig").alias("v"), F.count("*").alias("c")).where("c > 1").drop("c")
        block = components(posts.join(first, "h").select(F.col("sig").alias("u"), "v").distinct())
        block = block.select(F.col("node").alias("sig"), F.col("component").alias("block"))
        with passing(sets.drop("prefix").join(block, "sig").join(cls.select("sig", "copies"), "sig"), "blocks") as members:
            chunks = members.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
            placed = members.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("sig"), "chunks"))
            placed = placed.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            placed = placed.withColumn("ci", F.least("chunk", "d")).withColumn("cj", F.greatest("chunk", "d")).drop("d", "chunks")
            tasks = max(8, (members.count() // 2000) * 2)
            placed = placed.withColumn("task", F.pmod(F.xxhash64("block", "ci", "cj"), F.lit(tasks)))
            found = stored(_verified(placed, num, den), "links")

    comp = components(found.where("links > 0").select(F.col("sig").alias("u"), F.col("root").alias("v")))
    comp = comp.select(F.col("node").alias("sig"), F.col("component").alias("comp"))
    links = found.groupBy("sig").agg(F.sum("links").alias("links"))
    cls = cls.join(comp, "sig", "left").join(links, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    low = cls.groupBy("comp").agg(F.min("doc").alias("component_id"))
    cls = cls.join(low, "comp").select("sig", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(cls, "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies of a smaller doc_id's component: one stays of each, and all rows without a doc_id.

    Null and empty texts are linked with nothing and stay; repeated rows stay or go together; all columns are kept, whatever their names.
    """
    id_ = unused("_id", docs.columns)
    first = near_duplicates(docs).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col(id_)), "left_semi")
