"""Taggers and the assembly of their tokens into entities.

A tagger is a function from the column of a paper's chunks (array of start, text) to the column of their tokens (an array
for each chunk of word, label, score, start, end; start and end may be null): `each_chunk` of an expression over a chunk's text, or an
iterator UDF around a model (operators.perceptron). So tagging and assembly stay in the row of the paper: nothing is exchanged.
`pattern_tagger` and `list_tagger` are expressions and need no weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_wordpiece, ws_trim
from ..schema import FINDING, SCORE_THRESHOLD, SPECIAL_TOKENS, type_of
from .chunks import chunk_text
from .spans import finding, match_places, no_findings, once

Tagger = Callable[[Column], Column]
TOKENS = "array<struct<word: string, label: string, score: double, start: int, end: int>>"
ENTITIES = "array<struct<type: string, start: int, end: int, score: double>>"


def each_chunk(tag: Callable[[Column], Column]) -> Tagger:
    """A tagger from an expression over one chunk's text."""
    return lambda chunks: F.transform(chunks, lambda c: tag(c["text"]))


def chunks(papers: DataFrame) -> DataFrame:
    return papers.select("paper_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk_ord", "c")).select("paper_id", "chunk_ord", "c.start", "c.text")


#: Words of the pattern tagger are runs of these signs without the dots at their end; it labels those of some shapes, all others are outside any entity.
_SIGN = "[A-Za-z0-9_.]"
_SHAPED = rf"(?<!{_SIGN})(?:(?:\d{{1,3}}\.){{3}}\d{{1,3}}|[0-9a-f]{{32,}}+|\d++)(?=\.*+(?!{_SIGN}))"


def _token(text: Column, p: Column, label: Callable[[Column], Column], score: Callable[[Column], Column]) -> Column:
    def made(word: Column) -> Column:
        return F.struct(word.alias("word"), label(word).alias("label"), score(word).cast("double").alias("score"), p["start"].alias("start"), p["end"].alias("end"))

    return once(F.substring(text, p["start"] + 1, p["end"] - p["start"]), made)


def pattern_tagger(text: Column) -> Column:
    """Labels from the shape of words: IPv4 addresses, five-digit and four-digit numbers, ages, hex identifiers."""

    def label(word: Column) -> Column:
        return (
            F.when(word.contains("."), "B-IPV4").when(word.rlike(r"[a-f]") | (F.length(word) >= 32), "B-BITCOINADDRESS").when(word.rlike(r"^\d{5}\z"), "B-ZIPCODE")
            .when(word.rlike(r"^(?:19|20)\d\d\z"), "B-DATE").when(word.rlike(r"^\d{1,2}\z"), "B-AGE").otherwise("I-PIN")
        )

    score = lambda word: F.when(word.rlike(r"^\d{1,2}\z"), 0.35).otherwise(0.9)
    places = F.when(text.rlike(r"\d|[a-f]{32}"), match_places(text, _SHAPED))
    made = F.transform(places, lambda p: _token(text, p, label, score))
    return F.coalesce(made, F.array().cast(TOKENS)).cast(TOKENS)


def list_tagger(words: dict[str, list[str]], score: float = 0.8) -> Tagger:
    """Labels from lists of words, such as given names or places; words are runs of letters. A word of several lists has the first one's label."""
    known = {w: label for label, ws in reversed(words.items()) for w in ws}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])

    def tag(text: Column) -> Column:
        each = F.transform(match_places(text, r"\p{L}++"), lambda p: _token(text, p, lambda w: F.coalesce(F.try_element_at(table, w), F.lit("O")), lambda w: F.lit(score)))
        return each.cast(TOKENS)

    return tag


def locate_tokens(chunk: Column, tokens: Column) -> Column:
    """Tokens with a and b, their place in the chunk; null where the word isn't found from the cursor on."""
    lower = F.lower(chunk)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<label: string, score: double, a: int, b: int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        word = clean_wordpiece(F.coalesce(t["word"], F.lit("")))
        given = t["start"].isNotNull() & t["end"].isNotNull() & (t["end"] > t["start"])
        at = F.when((word == "") | word.isin(SPECIAL_TOKENS), 0).otherwise(F.call_function("locate", F.lower(word), lower, acc["at"] + 1))
        a = F.when(given, t["start"]).when(at > 0, at - 1).cast("int")
        b = F.when(given, t["end"]).when(at > 0, at - 1 + F.length(word)).cast("int")
        cursor = F.when(given, F.greatest(acc["at"], t["end"])).otherwise(F.coalesce(b, acc["at"])).cast("int")
        one = F.struct(F.coalesce(t["label"], F.lit("O")).alias("label"), t["score"].alias("score"), a.alias("a"), b.alias("b"))
        return F.struct(cursor.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def with_tokens(parts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Chunks with `tokens` from rows (paper_id, chunk_ord, tok_ord, word, label, score, start, end) that a tagger elsewhere has made."""
    lists = tokens.groupBy("paper_id", "chunk_ord").agg(F.array_sort(F.collect_list(F.struct("tok_ord", "word", "label", "score", "start", "end"))).alias("t"))
    plain = F.transform("t", lambda t: F.struct(*[t[c].alias(c) for c in ("word", "label", "score", "start", "end")])).cast(TOKENS)
    return parts.join(lists, ["paper_id", "chunk_ord"], "left").withColumn("tokens", F.coalesce(plain, F.array().cast(TOKENS))).drop("t")


def entities_in(chunk: Column, tokens: Column, threshold: float = SCORE_THRESHOLD) -> Column:
    """Runs of tokens of one type in a chunk, with their mean score: a fold over the tokens, in the row.

    A token goes on with the run if nothing lies between, or one or two blanks and it isn't a B-.
    """
    kept = F.filter(tokens, lambda t: ~ws_trim(F.coalesce(t["word"], F.lit(""))).isin(SPECIAL_TOKENS))
    none = F.lit(None)
    start = F.struct(
        F.array().cast(ENTITIES).alias("done"), none.cast("string").alias("type"), none.cast("int").alias("a"), none.cast("int").alias("b"),
        F.lit(0.0).alias("sum"), F.lit(0).alias("n"),
    )

    def flushed(acc: Column) -> Column:
        one = F.struct(acc["type"].alias("type"), acc["a"].alias("start"), acc["b"].alias("end"), (acc["sum"] / acc["n"]).alias("score"))
        return F.when(acc["type"].isNotNull() & (acc["n"] > 0) & (acc["sum"] >= threshold * acc["n"]), F.concat(acc["done"], F.array(one))).otherwise(acc["done"])

    def step(acc: Column, t: Column) -> Column:
        def with_type(kind: Column) -> Column:
            gap = F.substring(chunk, acc["b"] + 1, t["a"] - acc["b"])
            inside = (t["a"] <= acc["b"]) | (gap.rlike(r"^[ \t]{1,2}\z") & ~t["label"].startswith("B-"))
            on = F.coalesce((kind == acc["type"]) & inside, F.lit(False))
            score, one = F.coalesce(t["score"], F.lit(0.0)), F.when(t["score"].isNotNull(), 1).otherwise(0)
            more = F.struct(acc["done"].alias("done"), acc["type"].alias("type"), acc["a"].alias("a"), t["b"].alias("b"), (acc["sum"] + score).alias("sum"), (acc["n"] + one).alias("n"))
            new = F.struct(flushed(acc).alias("done"), kind.alias("type"), t["a"].alias("a"), t["b"].alias("b"), score.alias("sum"), one.alias("n"))
            return F.when(on, more).otherwise(new)

        return once(F.when(t["a"].isNotNull(), type_of(t["label"])), with_type)

    return F.aggregate(locate_tokens(chunk, kept), start, step, flushed)


def entities(parts: DataFrame, threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """paper_id, chunk_ord, type, start, end (in the paper), score of chunks with `tokens`."""
    rows = parts.select("paper_id", "chunk_ord", "start", F.explode(entities_in(F.col("text"), F.col("tokens"), threshold)).alias("e"))
    return rows.select("paper_id", "chunk_ord", "e.type", (F.col("start") + F.col("e.start")).alias("start"), (F.col("start") + F.col("e.end")).alias("end"), "e.score")


def model_findings(parts: Column, tagger: Tagger) -> Column:
    """The tagger's entities in a text's chunks (chunk_text) as findings, in order: tokens and assembly in the row."""

    def placed(x: Column) -> Column:
        found = entities_in(x["c"]["text"], x["t"])
        return F.transform(found, lambda e: finding(e["type"], x["c"]["start"] + e["start"], x["c"]["start"] + e["end"], e["score"], F.lit("model")))

    both = F.zip_with(parts, tagger(parts), lambda c, t: F.struct(c.alias("c"), F.coalesce(t, F.array().cast(TOKENS)).cast(TOKENS).alias("t")))
    return F.coalesce(F.flatten(F.transform(both, placed)), no_findings())
