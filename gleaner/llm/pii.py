"""Personal data with offset-preserving deobfuscation.

Base identifiers come from four plain patterns. For disguised ones, three transducers rewrite a text one after the
other (homoglyphs and digits of other scripts; spelled digits; at/dot/plus disguises) and each keeps, for every
character that it writes, the source characters it stands for. The same four patterns then run on the rewritten
text, and what they find there is mapped back to source spans.

Scale: one pass, no shuffle; texts in which no transducer has work are not rewritten. The patterns run in linear
time on any text: possessive repeats, and e-mail addresses are grown outwards from each "@".

Defined results: a null text counts as empty and has no spans; overlapping spans of different kinds all count; of spans that
begin alike the longer one names the mark, then the kind listed first; repeated rows are each judged; a very long text is
searched whole; an empty table gives an empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"([0-9](?<![0-9]{2})[0-9]*+)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four plain patterns by kind, then start: code points, end exclusive."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- transducers -----------------------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B",
    "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I",
    "Ј": "J", "Ѕ": "S", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
#: Other signs for @ . - + and space; and characters without width.
SIGNS = {
    "@": "\uff20\ufe6b",
    ".": "\uff0e\uff61\u3002\u2024\u00b7\u2022\u2219\u22c5",
    "-": "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d",
    "+": "\uff0b\ufe62\u207a",
    " ": "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000",
}
NO_WIDTH = "\u00ad\u034f\u180e\u200b\u200c\u200d\u2060\u2061\ufeff"
#: Names of the digits 0-9 in four languages.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_OF = {w: str(i) for names in DIGIT_NAMES for i, w in enumerate(names.split())} | {"oh": "0", "nought": "0"}
AT_WORDS = r"(?:at|arroba|arobase|klammeraffe|ät)"
DOT_WORDS = r"(?:dot|punkt|point|punto|dt)"
OPEN, CLOSE = r"[(\[{<_*|]", r"[)\]}>_*|]"


@cache
def homoglyphs() -> dict[str, str]:
    """Character to ASCII: look-alike letters and signs, full width forms, mathematical letters, digits of any script."""
    table = dict(LOOKALIKES)
    for plain, signs in SIGNS.items():
        table |= dict.fromkeys(signs, plain)
    table |= dict.fromkeys(NO_WIDTH, "")
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if (d := unicodedata.decimal(c, None)) is not None:
            table[c] = str(d)
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x2460 <= code <= 0x2468:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table.setdefault(c, plain)
    return table


@cache
def glyph_set() -> frozenset[str]:
    return frozenset(homoglyphs())




def trie_pattern(words: list[str]) -> str:
    """An alternation of the words that shares prefixes; the longest word wins."""
    if words == [""]:
        return ""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    body = "|".join(re.escape(c) + trie_pattern(tails) for c, tails in heads.items())
    return f"(?:{body})?" if "" in words else f"(?:{body})"


_NAME = trie_pattern(sorted(DIGIT_OF))
SPELLED = re.compile(rf"(?<!\w){_NAME}(?:[ \t\n,-]{{1,3}}{_NAME})+(?!\w)", re.I)
ONE_SPELLED = re.compile(rf"(?<!\w){_NAME}(?!\w)", re.I)
BRACKET_SIGN = re.compile(rf"\s?{OPEN}\s?(?:(?P<at>{AT_WORDS}|@)|(?P<dot>{DOT_WORDS}|\.))\s?{CLOSE}\s?", re.I)
#: A bare " at " counts only with a disguised or plain dot further on in the same word group, a bare " dot " only inside one.
WORD_SIGN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9_%+-]+(?:(?:\.| {DOT_WORDS} )[A-Za-z0-9_%+-]+){{0,4}})"
    rf"(?P<at> {AT_WORDS} | ?@ ?)(?P<domain>[A-Za-z0-9-]+(?:(?: {DOT_WORDS} | \. |\.)[A-Za-z0-9-]+){{1,5}})",
    re.I,
)
DOT_IN = re.compile(rf" {DOT_WORDS} | \. ", re.I)
NUMBER_DOT = re.compile(rf"(?<=[0-9])\s?{DOT_WORDS}\s?(?=[0-9])", re.I)
#: Letters for digits inside a long number of mostly digits.
LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])[0-9OoIl](?:[ -]?[0-9OoIl]){12,18}(?![A-Za-z0-9])")
LETTER_IN = frozenset("OoIl")
PLUS = re.compile(r"(?<!\w)(?:\(plus\)|\[plus\]|plus|más)\s?(?=[0-9])", re.I)


class Aligned:
    """A rewritten text; start[i], end[i]: the source characters of its character i."""

    def __init__(self, text: str, start: np.ndarray | None = None, end: np.ndarray | None = None):
        self.text = text
        self.start = np.arange(len(text)) if start is None else start
        self.end = self.start + 1 if end is None else end

    def edited(self, edits: list[tuple[int, int, str]]) -> Aligned:
        """edits: non-overlapping (from, to, new text) in order."""
        if not edits:
            return self
        texts, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            texts += [self.text[last:a], new]
            starts += [self.start[last:a], np.full(len(new), self.start[a])]
            ends += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        return Aligned(
            "".join([*texts, self.text[last:]]),
            np.concatenate([*starts, self.start[last:]]),
            np.concatenate([*ends, self.end[last:]]),
        )


def glyphs(x: Aligned) -> Aligned:
    table, present = homoglyphs(), glyph_set().intersection(x.text)
    if not present:
        return x
    pattern = re.compile("[" + "".join(map(re.escape, sorted(present))) + "]")
    return x.edited([(*m.span(), table[m[0]]) for m in pattern.finditer(x.text)])


def folded(text: str) -> str:
    """Lower case of all that re.I takes for a letter of a digit name, character by character."""
    return text.replace("İ", "i").replace("ſ", "s").lower()


def spelled_digits(x: Aligned) -> Aligned:
    """A run of two or more spelled digits becomes those digits, joined."""
    edits = []
    for m in SPELLED.finditer(x.text):
        names = [(a.start(), a.end(), DIGIT_OF[folded(a[0])]) for a in ONE_SPELLED.finditer(x.text, *m.span())]
        for i, (a, b, d) in enumerate(names):
            edits.append((a, names[i + 1][0] if i + 1 < len(names) else b, d))
    return x.edited(edits)


def mostly_digits(number: str) -> bool:
    return sum(map(str.isdigit, number)) >= 8


def signs(x: Aligned) -> Aligned:
    x = x.edited([(*m.span(), "@" if m["at"] else ".") for m in BRACKET_SIGN.finditer(x.text)])
    edits = []
    for m in WORD_SIGN.finditer(x.text):
        bare, domain = m["at"].strip() != "@", m["domain"]
        if m["at"] == "@" and not DOT_IN.search(m[0]) or bare and not DOT_IN.search(domain):
            continue
        for part in ("local", "at", "domain"):
            if part == "at":
                edits.append((*m.span("at"), "@"))
            else:
                edits += [(*d.span(), ".") for d in DOT_IN.finditer(x.text, *m.span(part))]
    x = x.edited(edits)
    edits = []
    for m in LETTER_DIGITS.finditer(x.text):
        if mostly_digits(m[0]):
            edits += [(i, i + 1, "0" if x.text[i] in "Oo" else "1") for i in range(*m.span()) if x.text[i] in "OoIl"]
    x = x.edited(edits)
    x = x.edited([(*m.span(), ".") for m in NUMBER_DOT.finditer(x.text)])
    return x.edited([(*m.span(), "+") for m in PLUS.finditer(x.text)])


TRANSDUCERS = (glyphs, spelled_digits, signs)
#: Each is a necessary condition of the pattern it stands before: a second digit name; a disguised dot or a space beside an "@".
SECOND_NAME = re.compile(rf"[ \t\n,-]{_NAME}(?!\w)")
WORD_SIGN_PART = re.compile(rf"{DOT_IN.pattern}| @|@ ", re.I)


def has_work(text: str) -> bool:
    """Whether a pattern of any transducer has a match; where none has, each leaves the text as it is, so False is certain."""
    if not text.isascii() and not glyph_set().isdisjoint(text):
        return True
    if SECOND_NAME.search(folded(text)) and SPELLED.search(text):
        return True
    if BRACKET_SIGN.search(text) or NUMBER_DOT.search(text) or PLUS.search(text):
        return True
    if WORD_SIGN_PART.search(text) and WORD_SIGN.search(text):
        return True
    return any(mostly_digits(m[0]) and not LETTER_IN.isdisjoint(m[0]) for m in LETTER_DIGITS.finditer(text))


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans; and those that only the rewritten text shows, in source positions."""
    base = base_spans(text)
    if not has_work(text):
        return base, []
    x = Aligned(text)
    for step in TRANSDUCERS:
        x = step(x)
    if x.text == text:
        return base, []
    added = set()
    for kind, a, b in base_spans(x.text):
        lo, hi = int(x.start[a]), int(x.end[b - 1])
        if text[lo:hi] != x.text[a:b] and not any(k == kind and s <= lo and hi <= e for k, s, e in base):
            added.add((kind, lo, hi))
    return base, sorted(added, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return KINDS.index(span[0]), span[1], span[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=_order))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each maximal covered stretch replaced by the marks of the kinds that begin it."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_added", T.LongType()),
]


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: counts of base spans by kind, their digest, all spans, and how many the method added."""

    def make():
        def work(arr: pa.Array) -> list[pa.Array]:
            rows = []
            for body in arr.to_pylist():
                base, added = find_spans(body or "")
                kinds = [s[0] for s in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)))
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            return [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64()) for c, f in zip(columns, FIELDS, strict=True)]

        return work

    return C.map_texts(docs, text, [doc_id], FIELDS, make)


def redact_pii(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of docs; each found span, plain or disguised, becomes a mark of its kind. A null text stays null.

    `length`, where such a column exists, is set to the new length in code points of the changed texts.
    """
    from pyspark.sql import functions as F

    rows, names = C.by_position(docs)
    body = f"gl{names.index(text)}"

    def make():
        def work(arr: pa.Array) -> list[pa.Array]:
            out = []
            for body in arr.to_pylist():
                base, added = find_spans(body or "")
                out.append(redacted(body, base + added) if base or added else None)
            return [pa.array(out, pa.string())]

        return work

    marked = C.map_texts(rows, body, rows.columns, [T.StructField("new", T.StringType())], make)
    new = F.col("new")
    columns = {body: F.coalesce(new, F.col(body))}
    if length in names:
        size = f"gl{names.index(length)}"
        columns[size] = F.when(new.isNotNull(), F.char_length(new).cast(rows.schema[size].dataType)).otherwise(F.col(size))
    return marked.select(*[columns.get(c, F.col(c)) for c in rows.columns]).toDF(*names)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(C.read(spark, sf_dir, "documents"))
