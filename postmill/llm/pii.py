"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text as it stands. Where a text carries disguises, a chain of
transducers rewrites it: look-alike characters to ASCII, "at"/"dot" disguises to their signs,
spelled digits to digits. Each keeps, for every output character, the source characters it came
from, so identifiers found in the rewritten text are mapped back to code points of the source.
Found spans that touch a plain one of the same kind are left out, but for addresses that have all of a plain one
in them (its first letter may be a look-alike): these are given beside it. Plain ones always stay.

Null texts count as empty. Repeated rows are answered one by one. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import strings, text_batches
from .tokens import LETTERS, hash_words

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_HINT = re.compile(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
# Maximal digit chains only: a start within a chain never matches where the chain's start doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a local part reaches back from each @ to the last match at most."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at) if left < at else None
        if m:
            out.append((left, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def plain(text: str) -> list[tuple[str, int, int]]:
    """Identifiers of the text as it stands: (kind, start, end) by kind, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _IP_HINT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-9:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# Letters of other scripts that look like ASCII ones.
_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P", "Τ": "T",
    "﹫": "@", "＠": "@", "。": ".", "．": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_ODD = re.compile("[" + "".join(_LOOKS) + "！-～٠-٩۰-۹०-९⁰-⁹₀-₉①-⑨\U0001d400-\U0001d7ff]")
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_D = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_ITEM = rf"(?:(?<![A-Za-z]){_D}(?![A-Za-z])|[0-9]+)"
_SPELLED = re.compile(rf"(?:\bplus[\x20,-]+)?{_ITEM}(?:(?:[\x20,-]+(?:(?:dot|point)[\x20,-]+)?|\.){_ITEM})*(?![A-Za-z])", re.I)
_SPELLED_PART = re.compile(rf"plus|{_D}|dot|point|\.|[0-9]+", re.I)
_DOT = r"(?:\s*[\[({<]\s*(?:dot|punkt|point|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
#: Pieces of a text, each tried once at its place: signs in brackets, parts of names, blanks, and plain signs.
_PIECE = re.compile(r"(?P<sign>[\[({<]\s*(?:(?P<at>at|@)|dot|punkt|point|\.)\s*[\])}>])|(?P<part>[A-Za-z0-9-]+)|(?P<other>[_%+]+)|(?P<blank>\s+)|(?P<mark>[@.])", re.I)
_LABEL = re.compile(r"[A-Za-z]{2,24}(?![A-Za-z0-9])")
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|dot|punkt|point|[@.])\s*[\])}>]", re.I)
_TOP = frozenset("com org net edu gov mil int info biz io co ai app dev me tv us uk ca au nz ie de at ch fr be nl lu it es pt se no dk fi pl cz ru ua jp cn in br mx eu".split())
_DOTS = re.compile(_DOT, re.I)
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)


class Mapped:
    """A rewritten text; char k came from source code points [first[k], last[k])."""

    def __init__(self, text: str, first=None, last=None, changed=None):
        self.text = text
        self.first = list(range(len(text))) if first is None else first
        self.last = list(range(1, len(text) + 1)) if last is None else last
        self.changed = bytearray(len(text)) if changed is None else changed

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace disjoint, ascending [a, b) by strings; each new character stands for the whole replaced piece."""
        if not edits:
            return self
        parts, first, last, changed, at = [], [], [], bytearray(), 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            changed += self.changed[at:a] + b"\x01" * len(new)
            at = b
        parts.append(self.text[at:])
        return Mapped("".join(parts), first + self.first[at:], last + self.last[at:], changed + self.changed[at:])


def _looks(m: Mapped) -> Mapped:
    def plain_of(c: str) -> str:
        if c in _LOOKS:
            return _LOOKS[c]
        d = unicodedata.digit(c, None)
        return str(d) if d is not None else unicodedata.normalize("NFKC", c)

    return m.rewrite([(x.start(), x.end(), plain_of(x[0])) for x in _ODD.finditer(m.text)])


def _digits_spelled(m: Mapped) -> Mapped:
    edits = []
    for x in _SPELLED.finditer(m.text):
        parts = list(_SPELLED_PART.finditer(m.text, *x.span()))
        spelled = [p for p in parts if p[0].lower() in _DIGIT_WORDS]
        if not spelled:
            continue
        for p, after in zip(parts, [*parts[1:], None]):
            word = p[0].lower()
            new = "+" if word == "plus" else "." if word in ("dot", "point", ".") else _DIGIT_WORDS.get(word, word)
            # separators between the parts go with the part before
            end = after.start() if after else p.end()
            edits.append((p.start(), end, new))
    return m.rewrite(edits)


def _pieces(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of a text's pieces, in order. Kinds: part, other, at, dot, gap.

    Signs in brackets, @ and a bare at or dot between blanks take the blanks about them; other blanks and
    characters are gaps. A piece is looked at once and its blanks twice, so the time is linear."""
    found, end = [], 0
    for m in _PIECE.finditer(text):
        if m.start() > end:
            found.append(["gap", end, m.start()])
        kind = m.lastgroup if m.lastgroup != "at" else "sign"
        if kind == "sign":
            kind = "at" if m["at"] else "dot"
        elif kind == "mark":
            kind = "at" if m[0] == "@" else "dot"
        found.append([kind, *m.span()])
        end = m.end()
    for k in range(1, len(found) - 1):
        if found[k][0] == "part" and found[k - 1][0] == found[k + 1][0] == "blank":
            word = text[found[k][1] : found[k][2]].lower()
            if word in ("at", "dot"):
                found[k][0] = word
    out = []
    for k, (kind, a, b) in enumerate(found):
        if kind == "blank":
            about = [x for x in (found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None) if x]
            if any(x[0] in ("at", "dot") and text[x[1] : x[2]] != "." for x in about):
                continue
            kind = "gap"
        if kind in ("at", "dot") and text[a:b] != ".":
            if k and found[k - 1][0] == "blank":
                a = found[k - 1][1]
            if k + 1 < len(found) and found[k + 1][0] == "blank":
                b = found[k + 1][2]
        out.append((kind, a, b, text[a:b]))
    return out


def _disguised_addresses(text: str) -> list[list[tuple[str, int, int, str]]]:
    """Signs of what has the shape of an address, by its at-sign: parts and dots before it, labels and dots after it."""
    found, free, pieces = [], 0, _pieces(text)
    for k, piece in enumerate(pieces):
        if piece[0] != "at" or k < free:
            continue
        left = k
        while left > free and pieces[left - 1][0] in ("part", "other"):
            left -= 1
            if left > free + 1 and pieces[left - 1][0] == "dot" and pieces[left - 2][0] in ("part", "other"):
                left -= 1
        last, j = 0, k + 1
        while j < len(pieces) and pieces[j][0] == "part":
            if j > k + 1 and _LABEL.match(pieces[j][3]):
                last = j
            if j + 1 >= len(pieces) or pieces[j + 1][0] != "dot":
                break
            j += 2
        if left < k and last:
            found.append([p for p in pieces[left:last] if p[0] in ("at", "dot")] + [pieces[last]])
            free = last + 1
    return found


def _signs(m: Mapped) -> Mapped:
    edits = []
    for *signs, label in _disguised_addresses(m.text):
        at = next(k for k, s in enumerate(signs) if s[0] == "at")
        hidden = [s for s in signs if s[3] not in ("@", ".")]
        bare = not re.search(r"[\[({<@]", signs[at][3])
        # a bare "at" is a word unless a dot is disguised too, and all dots after it are or a known top domain ends it
        if bare and not (any(s[0] == "dot" and s[3] != "." for s in signs) and (all(s[3] != "." for s in signs[at + 1 :]) or _LABEL.match(label[3])[0].lower() in _TOP)):
            continue
        edits += [(s[1], s[2], "@" if s[0] == "at" else ".") for s in hidden]
    for x in _DOTTED_IP.finditer(m.text):
        edits += [(*s.span(), ".") for s in _DOTS.finditer(m.text, *x.span()) if s[0] != "."]
    edits.sort()
    return m.rewrite([e for k, e in enumerate(edits) if not k or e[0] >= edits[k - 1][1]])


def _hashes(words) -> np.ndarray:
    return np.sort(hash_words(pa.array(words), LETTERS)[0])


_DIGIT_HASHES = _hashes(list(_DIGIT_WORDS))
_DOT_HASHES = _hashes(["dot", "punkt"])


def hints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each row: has it a spelled digit; has it a spelled dot. One pass over the bytes."""
    words, rows = hash_words(col, LETTERS)
    digit = np.concatenate([[0], np.cumsum(np.isin(words, _DIGIT_HASHES))])
    dot = np.concatenate([[0], np.cumsum(np.isin(words, _DOT_HASHES))])
    return digit[rows[1:]] > digit[rows[:-1]], dot[rows[1:]] > dot[rows[:-1]]


def disguised(text: str, found: list[tuple[str, int, int]], spelled: bool = True, dotted: bool = True) -> list[tuple[str, int, int]]:
    """Identifiers that only the rewritten text shows, in source code points; none touches ``found`` of its kind, unless it is an address around it.

    ``spelled`` and ``dotted`` tell what ``hints`` saw; without look-alikes the text is left at once where neither holds.
    """
    odd = not text.isascii() and _ODD.search(text) is not None
    if not (odd or spelled or dotted or _BRACKETED.search(text)):
        return []
    m = Mapped(text)
    if odd:
        m = _looks(m)
    if spelled or odd:
        m = _digits_spelled(m)
    m = _signs(m)
    out, held = [], {kind: sorted((a, b) for k, a, b in found if k == kind) for kind in KINDS}
    for kind, a, b in plain(m.text):
        if not any(m.changed[a:b]):
            continue
        start, end = min(m.first[a:b]), max(m.last[a:b])
        near = bisect_left(held[kind], (end,))  # spans of a kind are disjoint: those that begin before the end, from the last on
        first = near
        while first and held[kind][first - 1][1] > start:
            first -= 1
        touched = held[kind][first:near]
        if not touched or kind == "email" and (start, end) not in touched and start <= touched[0][0] and touched[-1][1] <= end:
            held[kind][first:near] = [(start, end)]
            out.append((kind, start, end))
    return out


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda f: (KINDS.index(f[0]), f[1])))


def _find(batches):
    for batch in batches:
        rows, col = [], strings(batch.column(1))
        for text, spelled, dotted in zip(col.to_pylist(), *hints(col)):
            base = plain(text)
            more = disguised(text, base, spelled, dotted)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            plain_spans = _joined(base)
            rows.append((*counts, plain_spans, _joined(base + more) if more else plain_spans, len(more)))
        names = ["id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_disguised"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        cols = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=names)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_spans, spans, n_disguised) per row; counts are of plain spans."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_find, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string, n_disguised bigint").withColumnRenamed("id", id_col)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the plain spans, all spans, and how many were disguised."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_disguised")
