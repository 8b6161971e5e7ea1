"""Spelling variants: words one edit apart, by k-d trees over letter-count vectors.

Words are maximal runs of Latin letters (A-Z lower-cased, others as they are) over all texts. Two words are near if one
inserted, deleted or replaced code point makes one the other. A word's form is its near word of the largest count,
if that is at least twice its own; forms lead to a root.

Method: a word is a vector of letter counts. A replacement takes one from a letter and adds one to another
(L1 distance 2, equal lengths); an insertion adds one (distance 1, the next length). Each length
has a k-d tree whose splits are the most balanced (letter, count) of the whole vocabulary, found by histograms of all
words a level, until cells have at most CELL words. Words go to their own cell, as queries to the cells of their own length, of a higher number,
whose box one letter less and one letter more can reach, and to those of the next length that one letter more can reach: every pair meets once.
A task has one cell: there a tree with tight boxes goes down to BUCKET words, pruning queries by their distance to the box, and
pairs at the right distance are verified by the order of their letters. Tasks give counts and the best neighbour of each word, no list of pairs.

The trees are what the driver holds: about two entries for each CELL words of the vocabulary. A cell that no
split can part (words with the same letters) is dealt to tasks by hash; there are no pairs inside it. Long words are rows like others.

Nulls and empty texts have no words; a null doc_id never deletes a letter. Repeated rows count each. Ties of the count
go to the word that comes first in code-point order. Texts are read in slices of SLICE code points, cut between words, so a long text
needs no more memory than its longest run of letters. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bytes import give_back
from ._common import small_batches, stored

#: Of 97 words of a document one loses a letter; least length and count of a word; words of a cell and of a bucket.
DELETE, LEAST_LENGTH, LEAST_COUNT, CELL, BUCKET = 97, 5, 3, 20_000, 16
SLICE, HELD = 1 << 20, 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")  # a fixed value: letters, after A-Z are lower-cased


# --- words -----------------------------------------------------------------------


def runs(text: str) -> Counter:
    """The runs of letters of a text with their counts, slice by slice."""
    out: Counter = Counter()
    a = 0
    while a < len(text):
        b = min(a + SLICE, len(text))
        inside = _RUN.match(text, b) if _RUN.match(text, b - 1) else None  # a run goes on over the cut
        b = inside.end() if inside else b
        out.update(_RUN.findall(text, a, b))
        a = b
    return out


def lowered(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(doc_id: int | None, text: str, delete: int = DELETE) -> Iterator[tuple[str, int]]:
    """Words of a document with their counts; where `delete` divides the crc32 of doc_id and run, the run has lost a letter."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs(lowered(text)).items():
        h = 1 if doc_id is None else zlib.crc32(run.encode(), start)
        if h % delete == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n, length: words of all documents, counted where they are read before they are exchanged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in words_of(doc_id, text.as_py()):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()
        held.clear()
        give_back()

    small_batches(docs.sparkSession)
    read = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = read.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count).withColumn("length", F.length("word"))


# --- the trees of cells -------------------------------------------------------------


Tree = dict[int, tuple[int, int]]  # node -> (letter, count): up to that count left (2 * node), more right; other nodes are cells


def codes_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def home(codes: np.ndarray, tree: Tree) -> np.ndarray:
    """The cell of each word."""
    out = np.ones(len(codes), np.int64)
    stack = [(1, np.arange(len(codes)))]
    while stack:
        node, rows = stack.pop()
        if node not in tree:
            out[rows] = node
        elif len(rows):
            letter, most = tree[node]
            more = (codes[rows] == letter).sum(1) > most
            stack += [(2 * node, rows[~more]), (2 * node + 1, rows[more])]
    return out


def reached(codes: np.ndarray, tree: Tree, less: int, more: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cells and the words that reach their box by `less` letters fewer and `more` letters more, at most."""
    n = len(codes)
    stack = [(1, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), {}, {})]
    while stack:
        node, rows, down, up, lows, highs = stack.pop()
        if not len(rows):
            continue
        if node not in tree:
            yield node, rows
            continue
        letter, most = tree[node]
        c = (codes[rows] == letter).sum(1)
        low, high = lows.get(letter, 0), highs.get(letter, codes.shape[1] + 1)
        fewer = down + np.maximum(c - min(high, most), 0) - np.maximum(c - high, 0)
        greater = up + np.maximum(max(low, most + 1) - c, 0) - np.maximum(low - c, 0)
        left, right = fewer <= less, greater <= more
        stack.append((2 * node, rows[left], fewer[left], up[left], lows, highs | {letter: min(high, most)}))
        stack.append((2 * node + 1, rows[right], down[right], greater[right], lows | {letter: max(low, most + 1)}, highs))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """length, words, counts of a batch."""
    lengths, words, n = batch.column("length").to_numpy(), batch.column("word").to_pylist(), batch.column("n").to_numpy()
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, [words[i] for i in rows.tolist()], n[rows]


def fit(vocab: DataFrame, cell: int = CELL) -> tuple[dict[int, Tree], dict[tuple[int, int], int]]:
    """The tree of each length, and the parts of cells that stay above `cell` words as no split parts them.

    A level is one pass over the words of all cells above `cell`; the driver gets one row for each of these cells.
    """
    sizes = {(r["length"], 1): r["n"] for r in vocab.groupBy("length").agg(F.count("*").alias("n")).collect()}
    trees: dict[int, Tree] = {length: {} for length, _ in sizes}
    parts: dict[tuple[int, int], int] = {}
    wide = {k: n for k, n in sizes.items() if n > cell}
    while wide:
        shared = vocab.sparkSession.sparkContext.broadcast((trees, set(wide)))

        def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, open_ = shared.value  # noqa: B023
            held: Counter = Counter()
            for batch in batches:
                for length, words, _ in by_length(batch):
                    codes = codes_of(words, length)
                    nodes = home(codes, forest[length])
                    for node in np.unique(nodes).tolist():
                        if (length, node) in open_:
                            own = codes[nodes == node]
                            for letter in np.unique(own).tolist():
                                value, n = np.unique((own == letter).sum(1), return_counts=True)
                                held.update({(length, node, letter, v): k for v, k in zip(value.tolist(), n.tolist(), strict=True) if v})
            keys = list(zip(*held, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(list(k), pa.int64()) for k in keys), pa.array(list(held.values()), pa.int64())], ["length", "node", "letter", "value", "n"])

        counts = vocab.mapInArrow(histogram, "length long, node long, letter long, value long, n long").groupBy("length", "node", "letter", "value").agg(F.sum("n").alias("n"))
        above = counts.withColumn("right", F.sum("n").over(Window.partitionBy("length", "node", "letter").orderBy(F.desc("value"))))
        known = vocab.sparkSession.createDataFrame([(*k, n) for k, n in wide.items()], "length long, node long, total long")
        above = above.join(known, ["length", "node"])
        even = F.least("right", F.col("total") - F.col("right"))
        best = above.groupBy("length", "node").agg(F.max(F.struct(even.alias("even"), (-F.col("letter")).alias("l"), (-F.col("value")).alias("v"), "right", "total")).alias("b"))
        grown: dict[tuple[int, int], int] = {}
        for r in best.collect():
            length, node, b = r["length"], r["node"], r["b"]
            if b["even"] == 0:
                parts[length, node] = -(-b["total"] // cell)
                continue
            trees[length][node] = (-b["l"], -b["v"] - 1)
            grown |= {(length, 2 * node): b["total"] - b["right"], (length, 2 * node + 1): b["right"]}
        shared.destroy()
        wide = {k: n for k, n in grown.items() if n > cell}
    return trees, parts


MEMBER, SAME, SHORT = 0, 1, 2


def dealt(vocab: DataFrame, trees: dict[int, Tree], parts: dict[tuple[int, int], int]) -> DataFrame:
    """length, node, part (of a cell), kind, word, n: each word as member of its cell and as query to the cells that it can have a neighbour in."""
    shared = vocab.sparkSession.sparkContext.broadcast((trees, parts))  # two entries for each CELL words

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, split = shared.value
        names = ["length", "node", "part", "kind", "word", "n"]

        def rows(length: int, node: int, kind: int, words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            k = split.get((length, node), 1)
            if kind == MEMBER and k > 1:
                to = np.array([zlib.crc32(w.encode()) % k for w in words])
                parts_ = [(p, [words[i] for i in np.flatnonzero(to == p).tolist()], n[to == p]) for p in range(k)]
            else:
                parts_ = [(p, words, n) for p in range(k)]
            for p, ws, ns in parts_:
                same = [pa.array(np.full(len(ws), x, np.int64)) for x in (length, node, p, kind)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ws, pa.string()), pa.array(ns)], names)

        for batch in batches:
            for length, words, n in by_length(batch):
                codes = codes_of(words, length)
                own = home(codes, forest[length])
                for node in np.unique(own).tolist():
                    at = np.flatnonzero(own == node)
                    yield from rows(length, node, MEMBER, [words[i] for i in at.tolist()], n[at])
                for node, at in reached(codes, forest[length], 1, 1):
                    at = at[own[at] < node]
                    yield from rows(length, node, SAME, [words[i] for i in at.tolist()], n[at])
                if length + 1 in forest:
                    for node, at in reached(codes, forest[length + 1], 0, 1):
                        yield from rows(length + 1, node, SHORT, [words[i] for i in at.tolist()], n[at])

    return vocab.mapInArrow(work, "length long, node long, part long, kind long, word string, n long")


# --- search in a cell ------------------------------------------------------------------


def counted(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Letter-count vectors over the given letters."""
    return np.stack([(codes == x).sum(1) for x in letters], 1).astype(np.int8 if codes.shape[1] < 128 else np.int32)


def shared(queries: np.ndarray, members: np.ndarray) -> np.ndarray:
    """How many letters each member has in common with each query."""
    out = np.zeros((len(members), len(queries)), members.dtype)
    columns = np.ascontiguousarray(queries.T)
    for letter in np.flatnonzero(members.any(0)).tolist():
        out += np.minimum(members[:, letter, None], columns[letter])
    return out


def ordered_same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place."""
    return (a != b).sum(1) == 1


def ordered_short(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of b are those of a with one letter put in."""
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)  # letters alike from the front
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return ahead + behind >= a.shape[1]


def near_pairs(members: np.ndarray, queries: np.ndarray, short: bool, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray]:
    """Rows of queries and members that are one edit apart: queries of the members' length, or (short) of one letter less."""
    letters = np.union1d(np.unique(members), np.unique(queries))
    mine, their = counted(members, letters), counted(queries, letters)
    want, verify = (queries.shape[1], ordered_short) if short else (queries.shape[1] - 1, ordered_same)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(np.arange(len(members)), np.arange(len(queries)))]
    while stack:
        ms, qs = stack.pop()
        box, near = mine[ms], their[qs]
        low, high = box.min(0), box.max(0)
        off = np.maximum(low - near, 0).sum(1) <= 1
        off &= np.maximum(near - high, 0).sum(1) <= (0 if short else 1)
        qs = qs[off]
        if not len(qs):
            continue
        if len(ms) <= bucket or (low == high).all():
            step = max(1, (1 << 20) // len(ms))
            for a in range(0, len(qs), step):
                m, q = np.nonzero(shared(their[qs[a : a + step]], box) == want)
                q, m = qs[a + q], ms[m]
                for x in range(0, len(q), 1 << 18):
                    y = slice(x, x + (1 << 18))
                    ok = verify(queries[q[y]], members[m[y]])
                    found.append((q[y][ok], m[y][ok]))
            continue
        dim = int(box.var(0).argmax())
        right = box[:, dim] > np.floor(box[:, dim].mean())
        stack += [(ms[~right], qs), (ms[right], qs)]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))


def searched(cells: DataFrame) -> DataFrame:
    """word, n_near, best (its near word of the largest count), best_n: of what each cell has found."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        length = key[0].as_py()
        kind, n = table.column("kind").to_numpy(), table.column("n").to_numpy()
        words = np.array(table.column("word").to_pylist(), object)
        at = {k: np.flatnonzero(kind == k) for k in (MEMBER, SAME, SHORT)}
        codes = {k: codes_of(words[at[k]].tolist(), length - (k == SHORT)) for k in at if len(at[k])}
        a, b = [], []
        for k in (MEMBER, SAME, SHORT) if MEMBER in codes else ():
            for x in range(0, len(at[k]), 1 << 15):
                q, m = near_pairs(codes[MEMBER], codes[k][x : x + (1 << 15)], k == SHORT)
                q = q + x
                if k == MEMBER:  # both ways there: keep one
                    q, m = q[q < m], m[q < m]
                a.append(at[k][q])
                b.append(at[MEMBER][m])
        one, two = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        word, other = np.r_[one, two], np.r_[two, one]
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
        out = pa.table({
            "word": pa.array(words[word[first]], pa.string()), "n_near": pa.array(np.diff(np.r_[first, len(word)]), pa.int64()),
            "best": pa.array(words[other[first]], pa.string()), "best_n": pa.array(n[other[first]], pa.int64()),
        })
        give_back()
        return out

    return cells.groupBy("length", "node", "part").applyInArrow(work, "word string, n_near long, best string, best_n long")


def neighbours(vocab: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n_near, best, best_n of words that have a near word."""
    found = searched(dealt(vocab, *fit(vocab, cell)))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return each.select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root from rows (word, form): where forms lead. Each round doubles the way, and counts at least double at each form, so a few rounds do."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    vocab = stored(vocabulary(docs), "vocabulary")
    near = neighbours(vocab, cell)
    strong = F.col("best_n") >= 2 * F.col("n")
    rows = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")
    )
    rows = stored(rows, "forms")
    led = roots(rows.where("form is not null"))
    return rows.join(led, "word", "left").withColumn("root", F.coalesce("root", "word"))


_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [(192 + unicode(c) // 64)::UBIGINT, (128 + unicode(c) % 64)::UBIGINT] END))),
  lambda a, c: list_reduce(list_prepend(xor(a, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT)"""
ORACLE = rf"""WITH RECURSIVE tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS k FROM tok GROUP BY doc_id, w),
h AS (SELECT w, k, coalesce({_CRC}, 1) AS h FROM c),
e AS (SELECT CASE WHEN h % 97 = 0 THEN w[:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:] ELSE w END AS w, k FROM h),
v AS (SELECT w AS word, CAST(sum(k) AS BIGINT) AS n FROM e WHERE length(w) >= 5 GROUP BY w HAVING sum(k) >= 3),
d AS (SELECT word, n, i, CASE WHEN i = 1 THEN '' ELSE word[:i - 1] END || '*' || word[i + 1:] AS pattern, CASE WHEN i = 1 THEN '' ELSE word[:i - 1] END || word[i + 1:] AS short FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d AS a JOIN d AS b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.short = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.short = v.word),
g AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, max(m) AS form_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN g USING (word)),
o AS (SELECT f.word, f.n, f.n_near, f.form_n, (SELECT min(other) FROM p WHERE p.word = f.word AND p.m = f.form_n) AS form FROM f),
r AS (SELECT word, word AS root, form AS next FROM o UNION ALL SELECT r.word, o.word, o.form FROM r JOIN o ON o.word = r.next)
SELECT o.word, n, n_near, form, form_n, root FROM o JOIN r USING (word) WHERE r.next IS NULL"""
