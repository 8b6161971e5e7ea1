"""Word files: their text with the bytes of every text element, and rewriting of those bytes alone.

A part is read by one pass of an event parser, which tells where in the bytes each text element's content stands. The
text is the elements' contents with what lies between them; offsets are sums of lengths. Rewriting splices bytes, so all else in a
file, also in the part itself, stays as it was.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from itertools import accumulate
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The namespace of word-processing elements, the parts that hold text, and elements that stand for a sign.
NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_PART = re.compile(r"word/(document\d*|header\d+|footer\d+|footnotes|endnotes|comments)\.xml").fullmatch
_SIGNS = {"tab": "\t", "br": "\n", "cr": "\n"}
_SPACE = re.compile(rb"""\s+xml:space\s*=\s*(?:"[^"]*"|'[^']*')""")
_TAG_END = re.compile(rb"""(?:[^>"']|"[^"]*"|'[^']*')*>""").match


@dataclass
class Piece:
    """Text of one element; for text elements also where its tag starts, and its content starts and ends, in bytes."""

    text: str
    paragraph: int | None = None
    place: tuple[int, int, int] | None = None


def pieces(xml: bytes) -> list[Piece]:
    """The pieces of a part in UTF-8, in order, from one pass of events; paragraphs are told apart by number."""
    out: list[Piece] = []
    open_, begun, inside = [], [0], []
    parser = expat.ParserCreate("utf-8", " ")
    parser.buffer_text = True

    def start(name: str, _: dict) -> None:
        space, _, local = name.rpartition(" ")
        if space != NAMESPACE:
            return
        if local == "p":
            begun[0] += 1
            open_.append(begun[0])
        elif local == "t":
            inside.append((Piece("", open_[-1] if open_ else None), parser.CurrentByteIndex))
            out.append(inside[-1][0])
        elif local in _SIGNS:
            out.append(Piece(_SIGNS[local]))

    def end(name: str) -> None:
        if name == f"{NAMESPACE} p":
            open_.pop()
        elif name == f"{NAMESPACE} t":
            piece, tag = inside.pop()
            if parser.CurrentByteIndex > tag:  # else an empty element without an end tag
                piece.place = (tag, _TAG_END(xml, tag).end(), parser.CurrentByteIndex)

    def characters(text: str) -> None:
        if inside:
            inside[-1][0].text += text

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.Parse(xml, True)
    return out


def separated(found: list[Piece]) -> list[Piece]:
    """With a piece for each line end: before a text element of another paragraph than the last one's."""
    out, last, some = [], None, False
    for piece in found:
        if piece.paragraph is not None or piece.place is not None:
            if last is not None and piece.paragraph != last[0] and some:
                out.append(Piece("\n"))
            last = (piece.paragraph,)
        out.append(piece)
        some = some or bool(piece.text)
    return out


@dataclass
class Part:
    """A part's name, bytes in UTF-8, encoding in the file, first offset in the whole text, pieces and where each starts."""

    path: str
    xml: bytes
    encoding: str
    base: int
    pieces: list[Piece] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(p.text for p in self.pieces)

    @property
    def starts(self) -> list[int]:
        return [0, *accumulate(len(p.text) for p in self.pieces)]


def _encoding(raw: bytes) -> str:
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    named = re.match(rb"""(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding=["']([\w.-]+)""", raw)
    name = named[1].decode().lower() if named else "utf-8"
    return "utf-8" if name == "utf8" else name


def parts(content: bytes) -> tuple[str, list[Part]]:
    """The text and the parts that make it: documents first, then by name. A part that can't be parsed is left out."""
    out: list[Part] = []
    whole = ""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {n: not n.startswith("word/document") for n in z.namelist() if _PART(n)}
        if all(names.values()):
            raise ValueError("not a Word document")
        for path in sorted(names, key=lambda n: (names[n], n)):
            raw = z.read(path)
            encoding = _encoding(raw)
            try:
                xml = raw if encoding == "utf-8" else raw.decode(encoding).encode("utf-8")
                found = separated(pieces(xml))
            except (expat.ExpatError, LookupError, UnicodeError):
                continue
            whole += "\n" if whole else ""
            out.append(Part(path, xml, encoding, len(whole), found))
            whole += out[-1].text
    return whole, out


def node_edits(nodes: list[tuple[int, int]], hits: list[tuple[int, int, str]]) -> dict[int, list[tuple[int, int, str]]]:
    """For each touched node its cuts (from, to, what stands there), from disjoint, sorted hits over disjoint, sorted nodes.

    A hit's tag stands in the node where it starts; what it covers of others goes.
    """
    edits: dict[int, list[tuple[int, int, str]]] = {}
    starts, ends = np.array([a for a, _ in nodes], int), np.array([b for _, b in nodes], int)
    first = np.searchsorted(ends, [s for s, _, _ in hits], "right")
    last = np.searchsorted(starts, [e for _, e, _ in hits], "left")
    for (s, e, tag), i, j in zip(hits, first.tolist(), last.tolist(), strict=True):
        for k in range(i, j):
            a, b = nodes[k]
            if a < b:
                edits.setdefault(k, []).append((max(s, a) - a, min(e, b) - a, tag if a <= s else ""))
    return edits


def _applied(text: str, cuts: list[tuple[int, int, str]]) -> str:
    kept = [text[b:a] for (_, b, _), (a, _, _) in zip([(0, 0, ""), *cuts], [*cuts, (len(text), 0, "")], strict=True)]
    return "".join(x for pair in zip(kept, [*(tag for _, _, tag in cuts), ""], strict=True) for x in pair)


def _spliced(part: Part, hits: list[tuple[int, int, str]]) -> bytes:
    """The part's bytes with hits, in its own offsets, replaced."""
    starts = part.starts
    texts = [(i, p) for i, p in enumerate(part.pieces) if p.place]
    out, at = [], 0
    edits = node_edits([(starts[i], starts[i + 1]) for i, _ in texts], hits)
    for k in sorted(edits):
        piece = texts[k][1]
        tag, start, end = piece.place
        head = _SPACE.sub(b"", part.xml[tag : start - 1])
        out += [part.xml[at:tag], head, b' xml:space="preserve">', escape(_applied(piece.text, edits[k])).encode("utf-8", "surrogatepass")]
        at = end
    xml = b"".join([*out, part.xml[at:]])
    return xml if part.encoding == "utf-8" else xml.decode("utf-8").encode(part.encoding)


def rewrite(content: bytes, hits: list[dict]) -> bytes:
    """The file with hits (start, end, tag) replaced in its text elements; all other bytes of its members stay as they are."""
    ordered = sorted((h["start"], h["end"], h["tag"]) for h in hits)
    changed = {}
    for part in parts(content)[1]:
        size = part.starts[-1]
        own = [(s - part.base, e - part.base, tag) for s, e, tag in ordered if e > part.base and s < part.base + size]
        if own:
            changed[part.path] = _spliced(part, own)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for member in z.infolist():
            to.writestr(member, changed[member.filename] if member.filename in changed else z.read(member), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def read(files: DataFrame) -> DataFrame:
    """paper_id, text, ocr, error of rows paper_id, content; a damaged file has an error."""

    def text(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((parts(c)[0], None))
            except Exception as e:  # one file never fails the batch
                rows.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "error"])

    got = files.select("paper_id", F.pandas_udf(text, "text string, error string")("content").alias("r"))
    return got.select("paper_id", "r.text", F.lit(False).alias("ocr"), "r.error")


def scrubbed(files: DataFrame) -> DataFrame:
    """paper_id, content, error of rows paper_id, content, hits (array of start, end, tag; null: none); a damaged file has an error."""

    def work(content: pd.Series, hits: pd.Series) -> pd.DataFrame:
        rows = []
        for c, h in zip(content, hits, strict=True):
            try:
                rows.append((rewrite(c, [] if h is None else list(h)), None))
            except Exception as e:  # one file never fails the batch
                rows.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["content", "error"])

    done = files.select("paper_id", F.pandas_udf(work, "content binary, error string")("content", "hits").alias("r"))
    return done.select("paper_id", "r.content", "r.error")
