"""Exact phrase and proximity matches of benchmark items in documents, by a positional inverted index.

Method: words are numbered in every text. How often each item word occurs in all documents is
counted; in each window of an item (10 consecutive words; a shorter item is one
window) the rarest word is its anchor. Postings (document, position, the words around)
are kept for anchors alone, stored in the shared folder, and joined to the items'
anchors; offset-adjusted neighbours are then intersected outwards from the anchor: the
run of equal words around it is a match if it is as long as the window. Every window that
occurs is found through its own anchor. Only DataFrame functions are used.

Anchors that would pair a frequent word with many item positions are told apart by
their next and previous words in the join key where those lie within the window, so
that a posting meets only items that agree on three words.

Near matches are windows that stand in a document with up to two of ten words replaced. Such a window has a block of
three consecutive words left whole among its three blocks, so blocks are the terms looked up: the two texts are laid over each other
where they share one, and the words in place are counted. A block that very many documents have is dealt to SALTS tasks.

Nulls have no words. Items without words match nothing. Repeated items and rows give the
same result for each. A text is read whole, as an array of its words in its row; of it only postings are exchanged. Ties among rarest words go to the leftmost. Empty tables give
clean documents or an empty result. Extra columns are ignored by `phrase_matches`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import unused
from ._common import stored

WINDOW = 10
#: Words of a window that a near match may have replaced.
REPLACED = 2
SALTS = 16
#: Everything but digits, a-z and non-ASCII separates words.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. lower() does the same, and faster, where no other capital letter occurs."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), lambda w: w != "")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, key (tells repeated doc_ids with other texts apart), w."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), words(F.col("text")).alias("w"))


def _around(w: Column, at: Column, side: int, window: int) -> Column:
    """Up to window-1 words before (nearest first) or after a position (from 0)."""
    n = F.lit(window - 1)
    if side > 0:
        return F.slice(w, at + 2, n)
    first = F.greatest(at - n, F.lit(0))
    return F.when(at > 0, F.reverse(F.slice(w, first + 1, at - first))).otherwise(F.array().cast("array<string>"))


def anchors(items: DataFrame, counts: DataFrame, window: int = WINDOW, absent: int = 0, picks: int = 1) -> DataFrame:
    """item_id, need, at, word, left, right: the anchors of each item's windows.

    need: words that a match must have. counts: word, n over the documents. absent: how often words
    that no document has count; at 0 their windows have no anchor, as none can occur whole. picks: so many rarest words of a window are anchors.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.monotonically_increasing_id().alias("item"), words(F.col("text")).alias("w"))
    rows = stored(rows.where(F.size("w") > 0), "items")
    at = rows.select("item", F.posexplode("w").alias("at", "word")).join(counts, "word", "left").fillna(absent, ["n"])
    ahead = Window.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    term = F.struct("n", "at", "word")
    rare = F.min(term).over(ahead) if picks == 1 else F.explode(F.slice(F.array_sort("ahead"), 1, picks))
    at = at if picks == 1 else at.withColumn("ahead", F.collect_list(term).over(ahead))
    size = F.count("*").over(Window.partitionBy("item"))
    picked = at.withColumn("size", size).withColumn("rare", rare).where(F.col("at") <= F.greatest(F.col("size") - window, F.lit(0)))
    picked = picked.where("rare.n > 0").select("item", F.least("size", F.lit(window)).cast("int").alias("need"), F.col("rare.at").alias("at"), F.col("rare.word").alias("word")).distinct()
    return rows.join(picked, "item").select("item_id", "need", "at", "word", _around(F.col("w"), F.col("at"), -1, window).alias("left"), _around(F.col("w"), F.col("at"), 1, window).alias("right"))


def _agree(a: Column, b: Column) -> Column:
    """How many leading words two lists share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, False)
    return F.when(miss > 0, miss - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_literals: int = 20_000) -> DataFrame:
    """doc_id, key, item_id, first, last: positions of matched runs in documents.

    The words looked for go into the plan as a set if they are at most `most_literals`, else through a join.
    """
    rows = _rows(docs)
    vocabulary = stored(items.select(F.explode(words(F.col("text"))).alias("word")).distinct(), "vocabulary")
    counts = stored(_count(rows, vocabulary, most_literals), "counts")
    wanted = stored(anchors(items, counts, window), "queries")
    terms = wanted.select("word").distinct()
    found = stored(_postings(rows, terms, window, most_literals), "postings")
    key = lambda side: F.coalesce(F.get(side, F.lit(0)), F.lit(""))
    # a match of two words or more goes on to the right or to the left of its anchor: one join for each
    pairs = []
    for side, other in (("right", "left"), ("left", "right")):
        need = wanted.where((F.size(side) > 0) if side == "right" else (F.col("need") > 1))
        q = need.select("item_id", "need", "word", key(F.col(side)).alias("near"), F.col(side).alias("q1"), F.col(other).alias("q2")).where("near <> ''")
        d = found.select("doc_id", "key", "at", "word", key(F.col(side)).alias("near"), F.col(side).alias("d1"), F.col(other).alias("d2")).where("near <> ''")
        a, b = _agree(F.col("d1"), F.col("q1")), _agree(F.col("d2"), F.col("q2"))
        m = d.join(q, ["word", "near"]).select("doc_id", "key", "item_id", "need", "at", a.alias("a"), b.alias("b"))
        before, after = ("b", "a") if side == "right" else ("a", "b")
        pairs.append(m.where(F.col("a") + F.col("b") + 1 >= F.col("need")).select("doc_id", "key", "item_id", (F.col("at") - F.col(before)).alias("first"), (F.col("at") + F.col(after)).alias("last")))
    alone = wanted.where("need = 1").select("item_id", "word").distinct()
    pairs.append(found.join(alone, "word").select("doc_id", "key", "item_id", F.col("at").cast("long").alias("first"), F.col("at").cast("long").alias("last")))
    return pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct()


def _literals(terms: DataFrame, most: int) -> list[str] | None:
    """The terms where they are few enough for a set in the plan."""
    got = [r[0] for r in terms.limit(most + 1).collect()]
    return None if len(got) > most else got


def _count(rows: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    few = _literals(vocabulary, most)
    if few is not None:
        return rows.select(F.explode(F.filter("w", lambda w: w.isin(few) if few else F.lit(False))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return rows.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(vocabulary, "word")


def _postings(rows: DataFrame, terms: DataFrame, window: int, most: int) -> DataFrame:
    """doc_id, key, at, word, left, right for each occurrence of a term."""
    few = _literals(terms, most)
    if few is not None:
        hit = lambda w, i: F.when(w.isin(few) if few else F.lit(False), i)
        at = F.array_compact(F.transform("w", hit))
        near = F.transform(at, lambda i: F.struct(i.alias("at"), F.get("w", i).alias("word"), _around(F.col("w"), i, -1, window).alias("left"), _around(F.col("w"), i, 1, window).alias("right")))
        return rows.select("doc_id", "key", F.inline(near))
    near = F.transform("w", lambda w, i: F.struct(i.alias("at"), w.alias("word"), _around(F.col("w"), i, -1, window).alias("left"), _around(F.col("w"), i, 1, window).alias("right")))
    return rows.select("doc_id", "key", F.inline(near)).join(terms, "word", "left_semi").select("doc_id", "key", "at", "word", "left", "right")


def blocks(items: DataFrame, window: int = WINDOW, replaced: int = REPLACED) -> DataFrame:
    """item_id, need, size, long, at, block, left, right: the blocks of an item's windows, with the words around.

    A window of `size` words may lack replaced/window of them (rounded down), so of its consecutive blocks, one more than that, one is whole.
    need: words that must be in place. A block has up to three words, fewer in short items.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    rows = rows.withColumn("size", size).withColumn("gone", F.floor(F.col("size") * replaced / window).cast("int"))
    rows = rows.withColumn("long", F.least(F.lit(3), F.floor(F.col("size") / (F.col("gone") + 1)).cast("int")))
    of_window = lambda s: F.transform(F.sequence(F.lit(0), F.col("gone")), lambda j: s + j * F.col("long"))
    at = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("size")), of_window)))
    each = rows.select("item_id", "size", "long", "w", (F.col("size") - F.col("gone")).alias("need"), F.explode(at).alias("at"))
    return each.select("item_id", "need", "size", "long", "at", _block(F.col("w"), F.col("at"), F.col("long")).alias("block"), _around(F.col("w"), F.col("at"), -1, window).alias("left"), _around(F.col("w"), F.col("at"), 1, window).alias("right"))


def _block(w: Column, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(w, at + 1, size), " ")


def _block_postings(rows: DataFrame, wanted: DataFrame, window: int, most: int) -> DataFrame:
    """doc_id, key, at, block, left, right for each occurrence of a block."""
    lengths = [r[0] for r in wanted.select("long").distinct().collect()]  # 1 to 3
    terms = wanted.select("block").distinct()
    few = _literals(terms, most)
    w = F.col("w")
    first = sorted({b.split(" ")[0] for b in few or []})
    wide = lambda i, n: F.struct(i.alias("at"), _block(w, i, F.lit(n)).alias("block"), _around(w, i, -1, window).alias("left"), _around(w, i, 1, window).alias("right"))

    def places(n: int) -> Column:
        if few is None:
            return F.transform(w, lambda x, i: wide(i, n))
        hit = F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(first) & _block(w, i, F.lit(n)).isin(few), i))) if few else F.array().cast("array<int>")
        return F.transform(hit, lambda i: wide(i, n))

    made = rows.select("doc_id", "key", F.inline(F.concat(*[places(n) for n in lengths or [3]])))
    return made if few is not None else made.join(terms, "block", "left_semi").select("doc_id", "key", "at", "block", "left", "right")


def near_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, replaced: int = REPLACED, most_literals: int = 20_000) -> DataFrame:
    """doc_id, key, item_id, first, same: items of which a window stands in the document with at most `replaced` words replaced.

    first: where the best such window starts in the document (the leftmost, if several are as good); it may lie up to `replaced` words outside.
    same: its words in place. A shorter item is one window and may lack that share of its words, rounded down. Nulls and items without words match nothing.
    """
    rows = _rows(docs)
    wanted = stored(blocks(items, window, replaced), "blocks")
    found = _block_postings(rows, wanted, window, most_literals)
    spread = wanted.select("item_id", "need", "size", "block", F.col("left").alias("q1"), F.col("right").alias("q2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "at"), F.lit(SALTS)).cast("int"))
    in_place = lambda d, q: F.slice(F.zip_with(d, q, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(1), F.size(q))
    laid = salted.join(spread, ["block", "salt"]).withColumn("same", F.concat(F.reverse(in_place(F.col("left"), F.col("q1"))), F.array(F.lit(1)), in_place(F.col("right"), F.col("q2"))))
    total = lambda t: F.aggregate(F.slice("same", t + 1, F.col("size")), F.lit(0), lambda a, x: a + x)
    windows = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("size")), lambda t: F.struct(total(t).alias("same"), (F.size("q1") - F.col("at") - t).alias("back")))
    best = laid.select("doc_id", "key", "item_id", "need", F.array_max(windows).alias("best")).where("best.same >= need")
    top = best.groupBy("doc_id", "key", "item_id").agg(F.max("best").alias("best"))
    return top.select("doc_id", "key", "item_id", (-F.col("best.back")).cast("long").alias("first"), F.col("best.same").alias("same"))


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 3, at_least: int = 7) -> DataFrame:
    """doc_id, item_id, at, near: windows of which at least `at_least` words occur in order-free reach of an anchor.

    Words of the item's window must lie within window-1+slop positions of the anchor's place in the document.
    Anchors are the rarest words that documents have, one more than may be missing, so that one is there in every match. Where the window has fewer different words than
    `at_least`, all of them are asked for.
    """
    rows = _rows(docs)
    vocabulary = items.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    wanted = stored(anchors(items, _count(rows, vocabulary, 0), window, 1 << 62, window - at_least + 1), "queries")
    found = _postings(rows, wanted.select("word").distinct(), window + slop, 20_000)
    q = wanted.select("item_id", "need", "word", F.array_distinct(F.concat("left", F.array("word"), "right")).alias("q"))
    d = found.select("doc_id", "at", "word", F.concat("left", F.array("word"), "right").alias("d"))
    near = F.size(F.array_intersect("q", "d"))
    return d.join(q, "word").withColumn("near", near).where(F.col("near") >= F.least(F.lit(at_least), F.col("need"), F.size("q"))).groupBy("doc_id", "item_id").agg(F.min_by("at", -F.col("near")).alias("at"), F.max("near").alias("near"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near, near_sha256 (items with near matches, exact ones too) of every row."""
    runs = stored(phrase_matches(docs, items, window), "matches")
    hits = runs.select("doc_id", "key", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"))
    near = near_matches(docs, items, window).select("doc_id", "key", "item_id", F.lit(False).alias("exact"))
    both = runs.select("doc_id", "key", "item_id", F.lit(True).alias("exact")).unionByName(near)
    names = lambda item: F.array_sort(F.collect_set(item))
    which = both.groupBy("doc_id", "key").agg(names(F.when(F.col("exact"), F.col("item_id"))).alias("items"), names(F.col("item_id")).alias("near"))
    rows = _rows(docs).select("doc_id", "key", F.size("w").cast("long").alias("n_words"))
    out = rows.join(hits, ["doc_id", "key"], "left").join(which, ["doc_id", "key"], "left")
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    digest = lambda c: F.sha2(F.coalesce(F.array_join(c, ","), F.lit("")), 256)
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), count("items").alias("n_items"), digest("items").alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), count("near").alias("n_near"), digest("near").alias("near_sha256"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows without any match, all columns kept, whatever their names; a missing doc_id makes no difference.

    Null and empty texts stay, as do all rows where there are no items; repeated rows stay or go together. Texts are read whole.
    """
    id_, key_ = unused("_id", docs.columns), unused("_key", docs.columns)
    bad = phrase_matches(docs, items, window).select(F.col("doc_id").alias(id_), F.col("key").alias(key_)).distinct()
    match = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key_))
    return docs.join(bad, match, "left_anti")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS t(i)),
m AS (SELECT DISTINCT doc_id, item_id, i, k FROM occ JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
nw AS (
  SELECT DISTINCT item_id, k, k * 2 // 10 AS gone, w[i:i + k - 1] AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(i)),
blk AS (
  SELECT item_id, k, gone, g, j * least(3, k // (gone + 1)) AS off, least(3, k // (gone + 1)) AS size
  FROM nw, unnest(range(0, gone + 1)) AS t(j)),
db AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS b
  FROM dw, (SELECT DISTINCT size FROM blk), unnest(range(1, len(w) - size + 2)) AS t(i)),
cand AS (
  SELECT DISTINCT doc_id, item_id, k, gone, g, i - off AS p
  FROM blk JOIN db ON db.size = blk.size AND db.b = array_to_string(g[off + 1:off + blk.size], ' ')),
nr AS (
  SELECT DISTINCT doc_id, item_id FROM cand JOIN dw USING (doc_id)
  WHERE len(list_filter(range(1, k + 1), lambda x: p + x - 1 BETWEEN 1 AND len(w) AND w[p + x - 1] = g[x])) >= k - gone),
nits AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM nr) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near_names, '')) AS near_sha256
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN nits USING (doc_id)
"""
