"""The ordered detection rules, as Java regexes and as RE2 for the oracle.

Word boundaries are ASCII. RE2 has no lookahead: its phone rule takes one character more
and its match is group 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from .text import WS

# The rules, in order.
_SCHOOL = r"(?:[A-Z][A-Za-z'’\-]+ ){1,4}(?:Elementary|Middle|High|Academy|University|College)(?: School)?"
_SCHOOL_2 = r"(?:[A-Z][A-Za-z'’\-]+ ){1,4}School"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@dataclass(frozen=True)
class Rule:
    type: str
    java: str
    re2: str
    first: str  # what a sign starts with, for use in a class
    sign: str  # a Java regex that every text with a match has, and few others

    def hint(self, text: Column) -> Column:
        return text.rlike(self.sign)


def _bounded(r: str) -> str:
    return rf"(?<!\w){r}(?!\w)"


_PHONE = r"(?:\+?1[{ws}.\-]?)?(?:\(\d{{3}}\)[{ws}]?|\d{{3}}[{ws}.\-])\d{{3}}[{ws}.\-]\d{{4}}"
#: Mails start at the first character of their run (or where the last match ended), so a run is read once.
_EMAIL_ONCE = r"(?:(?<![A-Za-z0-9._%+-])|\G)" + _EMAIL.replace("]+@", "]++@")
_SCHOOL_WORDS = "Elementary|Middle|High|Academy|University|College|School"

RULES = [
    Rule("EMAIL", _EMAIL_ONCE, _EMAIL, "@", "@"),
    Rule("PHONE", _PHONE.format(ws=WS) + r"(?!\d)", "(" + _PHONE.format(ws=r"\s") + r")(?:\D|$)", r"\d", r"\d{3}\W\d{4}"),
    Rule("SSN", _bounded(r"\d{3}-\d{2}-\d{4}"), r"\b\d{3}-\d{2}-\d{4}\b", r"\d", r"\d-\d{2}-\d"),
    Rule("ID", _bounded(r"\d{7,16}"), r"\b\d{7,16}\b", r"\d", r"\d{7}"),
    Rule("ORG", f"{_bounded(_SCHOOL)}|{_bounded(_SCHOOL_2)}", rf"\b{_SCHOOL}\b|\b{_SCHOOL_2}\b", "EMHAUCS", _SCHOOL_WORDS),
]


def any_sign(rules: list[Rule]) -> str:
    """A Java regex for a sign of any rule, so that one pass tells the texts in which none matches: signs are tried where their first character stands."""
    firsts, signs = "".join(r.first for r in rules), "|".join(r.sign for r in rules)
    return f"[{firsts}](?<=(?={signs}).)"
