"""Column functions over text. White space is Unicode's, as in ECMAScript."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space: a fixed value, for use inside a regex class.
WS = r"\t\n\x0B\f\r    -     　﻿"


def ws_trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^[{WS}]+|[{WS}]+\z", "")


def is_blank(s: Column) -> Column:
    """Whether there is nothing but white space: known at the first other character."""
    return ~s.rlike(rf"[^{WS}]")


def non_space_length(s: Column) -> Column:
    """Characters that are no white space: the measure of whether extraction found text."""
    return F.length(F.regexp_replace(s, rf"[{WS}]+", ""))


def tag_key(surface: Column) -> Column:
    """What makes two surfaces the same value: case, white space and closing marks apart."""
    one_space = F.regexp_replace(F.lower(surface), rf"[{WS}]+", " ")
    return ws_trim(F.regexp_replace(one_space, r"[.,;:!?]+\z", ""))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def out_name(name: Column, extension: str) -> Column:
    base = strip_extension(name)
    return F.concat(F.when(base == "", "paper").otherwise(base), F.lit(f"-scrubbed.{extension}"))


def clean_wordpiece(word: Column) -> Column:
    return ws_trim(F.regexp_replace(F.regexp_replace(word, "^##", ""), "^[▁Ġ]+", ""))


def trailing_blanks(s: Column) -> Column:
    return F.regexp_replace(s, "[ \t]+\n", "\n")


def tag(ph: Column, n: Column, n_distinct: Column) -> Column:
    """[PH], or [PH n] where the batch has several values of the type."""
    return F.when(n_distinct > 1, F.concat(F.lit("["), ph, F.lit(" "), n.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), ph, F.lit("]")))


def encode_handoff(title: Column, text: Column) -> Column:
    """#gdoc= and web-safe base64 of {t, x} as JSON."""
    packed = F.base64(F.encode(F.to_json(F.struct(title.alias("t"), text.alias("x"))), "UTF-8"))
    return F.concat(F.lit("#gdoc="), F.translate(F.regexp_replace(packed, r"[\r\n]", ""), "+/", "-_"))


def decode_handoff(fragment: Column) -> Column:
    """{t, x} of a fragment; null where it is malformed or x is blank."""
    packed = F.regexp_extract(fragment, r"^#gdoc=([A-Za-z0-9\-_]+=*)\z", 1)
    raw = F.try_to_binary(F.translate(F.when(packed != "", packed), "-_", "+/"), F.lit("base64"))
    got = F.from_json(F.try_validate_utf8(raw.cast("string")), "t string, x string")
    return F.when(ws_trim(got["x"]) != "", got)
