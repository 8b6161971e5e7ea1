"""The Merkle manifest against a plain version with hashlib."""

import hashlib
import zlib

import numpy as np
import pytest

from inkveil.llm import merkle

from .conftest import SF


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def build(nodes, fan):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def walk(tree, at, digest, fan):
    proof = []
    for level in tree[:-1]:
        first = at - at % fan
        run = list(level[first : first + fan])
        proof += run[: at - first] + run[at - first + 1 :]
        run[at - first] = digest
        digest, at = H(*run), at // fan
    return proof, digest


def plain(rows, fan=2):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted result rows."""
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: build([leaf(r) for r in groups[g]], fan) for g in order}
    top = build([trees[g][-1][0] for g in order], fan)
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            bad = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            one, digest = walk(trees[g], i, leaf([*r[:3], r[3] + 1, r[4]] if bad else r), fan)
            two, digest = walk(top, k, digest, fan)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*one, *two), digest, digest == top[-1][0]))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_compress_is_sha256():
    text = [H(str(i)) for i in range(5)]
    digest = np.stack([np.frombuffer(bytes.fromhex(t), ">u4").astype(np.uint32) for t in text])
    state = merkle.absorb(merkle.absorb(merkle.fresh(5), digest), digest[::-1])
    got = [x.astype(">u4").tobytes().hex() for x in merkle.finish(state, np.full(5, 2))]
    assert got == [H(a, b) for a, b in zip(text, text[::-1])]
    assert merkle.finish(merkle.fresh(1), np.zeros(1, int)).astype(">u4").tobytes().hex() == H()


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert collected(merkle.verified(docs)) == plain(rows)


@pytest.mark.parametrize("fan, height", [(2, 1), (2, 3), (3, 1), (3, 2), (5, 1)])
def test_blocks_and_rounds(spark, fan, height):
    rows = [(i, "s", "abc"[min(2, i % 5)] if i % 11 else None, i, str(i)) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    from pyspark.sql import functions as F

    bad = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    made = merkle.manifest(docs, fan=fan, height=height, tampered={"n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    got = sorted(((r.key, *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), r.folded_root == r.root) for r in merkle.fold(made, made.leaves).collect()), key=str)
    assert got == plain(rows, fan)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()] + [(None, None, None, None, None), (None, "a", "é", None, ""), (7, "s", None, 7, "one two"), (7, "s", None, 7, "one two"), (7, "s", None, 8, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clashing = docs.selectExpr("*", "1 as idx", "2 as g", "3 as _range", "4 as leaf", "5 as n", "6 as block")
    assert collected(merkle.verified(clashing)) == plain(rows)
    assert merkle.verified(nothing).collect() == []
    assert collected(merkle.verified(docs.where("n_chars = 8"))) == plain([r for r in rows if r[3] == 8])
