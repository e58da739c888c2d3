"""Markdown of word-processor files (.docx): paragraphs, headings, list items and tables; emphasis and pictures are left out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Parts of a paragraph that hold no text of their own, or the same once more.
_SKIPPED = {f"{_W}pPr", f"{_W}rPr", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"}
_SIGNS = {f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}tab": "\t", f"{_W}noBreakHyphen": "-"}
#: Bytes that a document's text may unpack to; a larger one is refused, not cut.
MOST_BYTES = 64 << 20


def _inline(node: ElementTree.Element) -> str:
    out = []
    for e in node:
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag not in _SKIPPED:
            out.append(_SIGNS[e.tag] if e.tag in _SIGNS else _inline(e))
    return "".join(out)


def _property(paragraph: ElementTree.Element, path: str) -> str | None:
    found = paragraph.find("/".join(f"{_W}{step}" for step in ("pPr", *path.split("/"))))
    return None if found is None else found.get(f"{_W}val", "")


def _paragraph(p: ElementTree.Element) -> tuple[str, bool]:
    """A paragraph's line, and whether it is an item of a list; the style or the outline level makes a heading."""
    text = _inline(p).strip()
    style = re.fullmatch(r"(?i)heading ?([1-6])|(title)", _property(p, "pStyle") or "")
    level = _property(p, "outlineLvl")
    if text and (style or level in {*"012345"}):
        depth = int(style[1] or 1) if style else int(level) + 1
        return f"{'#' * depth} {text}", False
    if text and _property(p, "numPr/numId") not in (None, "0"):
        return f"{'  ' * int(_property(p, 'numPr/ilvl') or 0)}- {text}", True
    return text, False


def _table(table: ElementTree.Element) -> str:
    lines = []
    for row in table.iterfind(f"{_W}tr"):
        cells = [" ".join(" ".join(_inline(p) for p in c.iter(f"{_W}p")).split()).replace("|", "\\|") for c in row.iterfind(f"{_W}tc")]
        lines.append(f"| {' | '.join(cells)} |")
        if len(lines) == 1:
            lines.append(f"|{' --- |' * len(cells)}")
    return "\n".join(lines)


def _blocks(parent: ElementTree.Element) -> Iterator[tuple[str, bool]]:
    for e in parent:
        if e.tag == f"{_W}p":
            yield _paragraph(e)
        elif e.tag == f"{_W}tbl":
            yield _table(e), False
        elif e.tag in (f"{_W}sdt", f"{_W}sdtContent"):
            yield from _blocks(e)


def _markdown(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        part = z.getinfo("word/document.xml")
        if part.file_size > MOST_BYTES:
            raise ValueError(f"text of {part.file_size} bytes")
        body = ElementTree.fromstring(z.read(part)).find(f"{_W}body")
    out, in_list = [], False
    for text, item in _blocks(body) if body is not None else ():
        if text:
            # items of a list follow each other without an empty line
            out += ["" if not out else "\n" if item and in_list else "\n\n", text]
            in_list = item
    return "".join(out)


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("problem", T.StringType()))
def docx_to_markdown(content: pa.Array) -> pa.Array:
    """(text, problem) of a file's bytes: one of the two is null, or both for null bytes. A file that can't be read says so, and leaves the others alone."""
    texts, problems = [], []
    for data in content:
        text = problem = None
        try:
            text = None if not data.is_valid else _markdown(data.as_py())
        except Exception as error:  # whatever is wrong with a file is told of that file
            problem = f"unreadable résumé ({type(error).__name__})"
        texts.append(text)
        problems.append(problem)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(problems, pa.string())], ["text", "problem"])
