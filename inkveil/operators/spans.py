"""Spans in text as DataFrame expressions: rule matches, expansion, overlaps, merging.

A finding is {type, start, end, score, source}, half-open, in code points. Everything here is
row-local: no shuffle, no Python. It is linear in the text and in the findings: a text with findings is cut once
into slabs of SLAB code points, from which pieces are taken without counting from the start of the text, and folds go
by blocks of BLOCK findings, so that no list is copied whole for each of its members.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.patterns import RULES, Rule, any_sign
from ..functions.text import WS, ws_trim
from ..schema import FINDING, FINDINGS

#: How far a finding's surroundings are looked at first; further only where all of that belongs to it.
NEAR = 64
SLAB, BLOCK = 256, 128
_LOOSE = rf"[^{WS}()\[\]{{}}<>,;:\"']"
_TIGHT = r"[A-Za-z0-9'’\-]"


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def finding(kind: Column, start: Column, end: Column, score: Column, source: Column) -> Column:
    return F.struct(kind.alias("type"), start.cast("int").alias("start"), end.cast("int").alias("end"), score.cast("double").alias("score"), source.alias("source"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slabs(text: Column) -> Column:
    """The text in pieces of SLAB code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLAB}}}+"), F.lit(0))


def cut(parts: Column, start: Column, size: Column) -> Column:
    """The `size` code points from `start` on, from a text's slabs: mostly one or two of them, as a slice of the array would copy it."""
    first = F.floor(start / SLAB).cast("int")
    n = F.floor((start + size) / SLAB).cast("int") - first + 1
    near = F.concat(F.coalesce(F.get(parts, first), F.lit("")), F.coalesce(F.get(parts, first + 1), F.lit("")))
    return F.substring(F.when(n <= 2, near).otherwise(F.array_join(F.slice(parts, first + 1, n), "")), start - first * SLAB + 1, size)


def scanned(items: Column, zero: Column, following: Callable[[Column, Column], Column], emitted: Callable[[Column, Column], Column], none: Column, last: Callable[[Column], Column] | None = None) -> Column:
    """A fold with output: each item gives `emitted(state, item)`, an array, and the state goes on as `following(state, item)`; `last` adds an array from the last state.

    Spark copies what a fold carries at every step. So the state at the head of each block of BLOCK items is found first, and
    then each block makes its own output: no step carries more than a block's.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.struct(following(acc["state"], x).alias("state"), F.concat(acc["out"], emitted(acc["state"], x)).alias("out"))

    def of(blocks: Column) -> Column:
        heads = F.aggregate(blocks, F.array(zero), lambda acc, b: F.concat(acc, F.array(F.aggregate(b, F.element_at(acc, -1), following))))

        def with_heads(hs: Column) -> Column:
            own = lambda b, i: F.aggregate(b, F.struct(F.get(hs, i).alias("state"), none.alias("out")), step, lambda acc: acc["out"])
            made = F.flatten(F.transform(blocks, own))
            return made if last is None else F.concat(made, last(F.element_at(hs, -1)))

        return once(heads, with_heads)

    def cut_up(xs: Column) -> Column:
        firsts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return once(F.transform(firsts, lambda k: F.slice(xs, k, F.lit(BLOCK))), of)

    return once(items, cut_up)


def match_places(text: Column, java: str | Column) -> Column:
    """array<struct<start, end>> of all matches of a regex: the texts between them give the offsets."""
    rule = F.lit(java) if isinstance(java, str) else java
    between = F.split(text, rule, -1)
    hits = F.regexp_extract_all(text, rule, F.lit(0))

    def sizes(found: Column) -> Column:
        return F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, h: F.struct(F.length(b).alias("b"), F.length(h).alias("h")))

    def place(at: Column, x: Column) -> Column:
        return F.array(F.struct((at + x["b"]).alias("start"), (at + x["b"] + x["h"]).alias("end")))

    none = F.array().cast("array<struct<start: int, end: int>>")
    return scanned(once(hits, sizes), F.lit(0), lambda at, x: at + x["b"] + x["h"], place, none)


def all_rule_matches(text: Column, rules: list[Rule] = RULES) -> Column:
    """Findings of all rules, rule by rule: one pass finds the texts with a sign of any rule, and in those, mostly few, the hints say which rules to look for."""
    known = F.array(*[F.struct(r.hint(text).alias("may"), F.lit(r.type).alias("type"), F.lit(r.java).alias("java")) for r in rules])

    def found(r: Column) -> Column:
        return F.transform(match_places(text, r["java"]), lambda p: finding(r["type"], p["start"], p["end"], F.lit(1.0), F.lit("regex")))

    made = F.flatten(F.transform(F.filter(known, lambda r: r["may"]), found))
    return F.coalesce(F.when(text.rlike(any_sign(rules)), made), no_findings())


def surface(parts: Column, f: Column) -> Column:
    """A finding's text, from the slabs of the whole one."""
    return cut(parts, f["start"], f["end"] - f["start"])


def grown_past(within: Callable[[Column], Column], rest: Column) -> Column:
    """What `within` a slice of so many characters counts, in slices of growing size, each read only if the one before is taken whole."""

    def unless_whole(n: int, further: Column) -> Column:
        return once(within(F.lit(n)), lambda k: F.when(k < n, k).otherwise(further))

    return unless_whole(NEAR, unless_whole(NEAR * 64, within(rest)))


def _run(parts: Column, size: Column, at: Column, loose: Column, side: int) -> Column:
    """How many loose or tight signs stand before (side < 0) or after a place of a text of `size` code points."""
    signs = lambda piece, cls: F.regexp_extract(piece, f"^{cls}*+", 0)
    rest = at if side < 0 else size - at

    def within(n: Column) -> Column:
        def taken(m: Column) -> Column:
            piece = cut(parts, at, m) if side > 0 else F.reverse(cut(parts, at - m, m))
            return once(piece, lambda x: F.length(F.when(loose, signs(x, _LOOSE)).otherwise(signs(x, _TIGHT))))

        return once(F.least(n, rest), taken)

    return grown_past(within, rest)


def expand(text: Column, findings: Column) -> Column:
    """Each finding grown to the whole word; e-mails, links and user names take more signs but give closing marks back."""
    loose = lambda f: f["type"].isin("EMAIL", "LINK", "USERNAME")

    def of(cuts: Column, fs: Column) -> Column:
        parts, size = cuts["parts"], cuts["size"]

        def grown(f: Column) -> Column:
            before, after = _run(parts, size, f["start"], loose(f), -1), _run(parts, size, f["end"], loose(f), 1)
            return finding(f["type"], f["start"] - before, f["end"] + after, f["score"], f["source"])

        def closed(f: Column) -> Column:
            marks = F.length(F.regexp_extract(F.reverse(surface(parts, f)), "^[.!?,;:]*+", 0))
            return F.when(loose(f), finding(f["type"], f["start"], f["end"] - marks, f["score"], f["source"])).otherwise(f)

        return F.transform(F.transform(fs, grown), closed)

    cuts = F.struct(slabs(text).alias("parts"), F.length(text).alias("size"))
    return once(findings, lambda fs: F.when(F.size(fs) > 0, once(cuts, lambda c: of(c, fs))).otherwise(fs))


def weight(f: Column) -> Column:
    return F.when(f["source"] == "regex", 1e9).otherwise(0.0) + (f["end"] - f["start"]) * 100 + f["score"]


def in_order(findings: Column) -> Column:
    """By start, longest first, then as given."""
    numbered = F.transform(findings, lambda f, i: F.struct(f["start"].alias("a"), (-f["end"]).alias("b"), i.alias("i"), f.alias("f")))
    return F.transform(F.array_sort(numbered), lambda x: x["f"])


def folded(findings: Column, meets: Callable[[Column, Column], Column], joined: Callable[[Column, Column], Column]) -> Column:
    """Findings in order, where one that `meets` the last one kept makes `joined` of the two."""
    on = lambda last, f: last.isNotNull() & meets(last, f)
    kept = lambda last: F.when(last.isNull(), no_findings()).otherwise(F.array(last))
    following = lambda last, f: F.when(on(last, f), joined(last, f)).otherwise(f)
    return scanned(findings, F.lit(None).cast(FINDING), following, lambda last, f: F.when(on(last, f), no_findings()).otherwise(kept(last)), no_findings(), kept)


def resolve(findings: Column) -> Column:
    """No overlaps: of a finding and the last one kept, the heavier stays (the last, if equal)."""
    heavier = lambda last, f: F.when(weight(f) > weight(last), f).otherwise(last)
    return once(in_order(findings), lambda fs: folded(fs, lambda last, f: f["start"] < last["end"], heavier))


def merge(text: Column, findings: Column) -> Column:
    """Findings of one type with at most three blanks, dots, commas, apostrophes or hyphens between them become one."""

    def of(parts: Column, fs: Column) -> Column:
        def near(last: Column, f: Column) -> Column:
            gap = f["start"] - last["end"]
            return (last["type"] == f["type"]) & (gap <= 3) & F.when(gap <= 0, True).otherwise(cut(parts, last["end"], gap).rlike(r"^[ \t.,'’\-]*\z"))

        joined = lambda last, f: finding(last["type"], last["start"], f["end"], F.greatest(last["score"], f["score"]), last["source"])
        return folded(fs, near, joined)

    return once(findings, lambda fs: F.when(F.size(fs) > 1, once(slabs(text), lambda parts: of(parts, fs))).otherwise(fs))


KEPT = "array<struct<id: int, type: string, start: int, end: int, score: double, source: string, enabled: boolean, surface: string>>"


def finished(text: Column, findings: Column) -> Column:
    """Those of two characters or more, with id, enabled and surface."""

    def of(parts: Column, fs: Column) -> Column:
        known = F.transform(fs, lambda f: F.struct(f.alias("f"), surface(parts, f).alias("s")))
        kept = F.filter(known, lambda x: F.length(ws_trim(x["s"])) >= 2)
        own = lambda x, i: F.struct(i.alias("id"), *(x["f"][c].alias(c) for c in ("type", "start", "end", "score", "source")), F.lit(True).alias("enabled"), x["s"].alias("surface"))
        return F.transform(kept, own)

    return once(findings, lambda fs: F.when(F.size(fs) > 0, once(slabs(text), lambda parts: of(parts, fs))).otherwise(F.array().cast(KEPT)).cast(KEPT))
