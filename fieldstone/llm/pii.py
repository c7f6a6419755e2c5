"""Personal data: identifiers as they stand, and identifiers in disguise. Transducers undo
homoglyphs, spelled digits and at/dot disguises while every character keeps the span of source
characters it came from, so what is found in the normalised text maps back to the source."""

from __future__ import annotations

import re
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.text import per_text, terms

KINDS = ("email", "ip", "card", "phone")
# What identifiers look like.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_DOTTED = re.compile(r"[0-9][0-9.]{6,}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Characters that look like ASCII ones (Cyrillic, Greek); full-width forms follow a rule.
_LOOKS = dict(zip("асеорхуіјѕһԁԛԝАВЕКМНОРСТХІЈЅαοενρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
                  "aceopxyijshdqwABEKMHOPCTXIJSaoevptuABEZHIKMNOPTYX", strict=True))
_LOOKS |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_LOOKS |= {chr(start + d): str(d) for start in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2) for d in range(10)}
_LOOKS |= {"․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", " ": " ", " ": " ", " ": " "}
_HIDDEN = "​‌‍⁠﻿­"
_ODD = re.compile(f"[{''.join(map(re.escape, _LOOKS))}{_HIDDEN}]")
# A look-alike only counts inside a word that also has plain ASCII letters or digits, @ or a dot.
_ODD_WORD = re.compile(r"\S+")

_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
           "seven": "7", "eight": "8", "nine": "9"}
_DIGIT = "|".join(_DIGITS)
_ITEM = rf"(?:{_DIGIT}|[0-9]+)"
_GAP = r"[\s,.()-]{1,4}"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[\s-]+)?{_ITEM}(?:{_GAP}{_ITEM})+(?![^\W_])")
_SPELLED_ITEM = re.compile(rf"(?i)plus|{_ITEM}")
_HAS_SPELLED = re.compile(rf"(?i)\b(?:{_DIGIT}){_GAP}{_ITEM}\b|[0-9]{_GAP}(?:{_DIGIT})\b")
_PART = r"[A-Za-z0-9%+_-]+"
_AT = r"(?:\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s*@\s*)"
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_MAIL = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])({_PART}(?:{_DOT}{_PART})*)({_AT})([A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+)")
_MAIL_HINT = re.compile(r"(?i)[\[({<]\s*(?:at|dot|\.)\s*[\])}>]|\sat\s(?:[^\n]{1,80}?)\sdot\s|\s@|@\s|@[^\n]{1,60}\sdot\s")
_HOST_DOTS = re.compile(r"(?i)(?<![0-9A-Za-z])[0-9]{1,3}(?:(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)[0-9]{1,3}){3}(?![0-9A-Za-z])")
_DOT_ONLY = re.compile(rf"(?i){_DOT}")
_DOT_HINT = re.compile(r"(?i)[0-9]\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|\sdot\s)\s*[0-9]")

# Ends of addresses that are no words.
_ENDS = frozenset("com org net edu gov mil info biz io co dev app de fr es uk eu ch ca au nl jp br pl se ru cn kr mx".split())

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append(("email", start, free))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def _dotted(text: str) -> Iterator[re.Match]:
    """Four numbers joined by dots; they lie whole within a run of digits and dots."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            yield from _IP.finditer(text, run.start(), run.end())


def find_plain(text: str) -> list[Span]:
    """Identifiers as they stand: leftmost and without overlap within a kind, in the order of KINDS."""
    out = _emails(text)
    for m in _dotted(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Mapped:
    """A text whose every character knows the span of source characters it stands for."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> Mapped:
        """Replace the given spans, in order and without overlap. Each new character stands for
        the whole span it replaces; a span replaced by nothing leaves no character."""
        text, starts, ends, at = [], [], [], 0
        for start, end, new in pieces:
            text.append(self.text[at:start])
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            text.append(new)
            starts += [self.starts[start]] * len(new)
            ends += [self.ends[end - 1]] * len(new)
            at = end
        text.append(self.text[at:])
        return Mapped("".join(text), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def undo_looks(m: Mapped) -> Mapped:
    """Look-alike characters to ASCII within words that mix them with ASCII, hidden ones to nothing."""
    pieces = []
    for word in _ODD_WORD.finditer(m.text):
        odd = list(_ODD.finditer(word[0]))
        if odd and re.search(r"[A-Za-z0-9@.]", word[0]) or odd and all(x[0] in _LOOKS for x in odd) and len(odd) == len(word[0]):
            pieces += [(word.start() + x.start(), word.start() + x.end(), _LOOKS.get(x[0], "")) for x in odd]
    return m.rewrite(pieces)


def undo_spelling(m: Mapped) -> Mapped:
    """Runs of three or more digits of which one is spelled: ``plus one, five five`` to ``+155``."""
    pieces = []
    for run in _SPELLED.finditer(m.text):
        items = list(_SPELLED_ITEM.finditer(run[0]))
        if len(items) < 3 or all(x[0].isdigit() for x in items):
            continue
        last = 0
        for x in items:
            word = x[0].lower()
            pieces.append((run.start() + last, run.start() + x.end(), "+" if word == "plus" else _DIGITS.get(word, word)))
            last = x.end()
    return m.rewrite(pieces)


def undo_signs(m: Mapped) -> Mapped:
    """``name [at] host dot tld`` to ``name@host.tld``, and spelled dots between the parts of an address."""
    pieces = []
    for x in _MAIL.finditer(m.text):
        if x[2].strip().lower() == "at":  # the bare word: only an address if a dot is disguised too and its end is known
            disguised = any(d[0] != "." for d in _DOT_ONLY.finditer(x[3]))
            if not disguised or re.split(r"[^A-Za-z0-9-]+", x[3])[-1].lower() not in _ENDS:
                continue
        for g in (1, 3):
            if g == 3:
                pieces.append((x.start(2), x.end(2), "@"))
            pieces += [(x.start(g) + d.start(), x.start(g) + d.end(), ".") for d in _DOT_ONLY.finditer(x[g])]
    taken = [(a, b) for a, b, _ in pieces]
    for x in _HOST_DOTS.finditer(m.text):
        if not any(a < x.end() and x.start() < b for a, b in taken):
            pieces += [(x.start() + d.start(), x.start() + d.end(), ".") for d in _DOT_ONLY.finditer(x[0])]
    return m.rewrite(sorted(pieces))


_SIGNS = re.compile(f"{_MAIL_HINT.pattern}|{_DOT_HINT.pattern.removeprefix('(?i)')}")
_DIGIT_TERMS = frozenset(d.encode() for d in _DIGITS)


def find_disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, as spans of the source."""
    mapped = None
    now = text
    if not text.isascii() and _ODD.search(text):
        mapped = undo_looks(Mapped(text))
        now = mapped.text
    # Most texts lack the words that a disguise needs, and go no further.
    words = frozenset(terms(now.encode("utf-8", "replace")))
    if not _DIGIT_TERMS.isdisjoint(words) and _HAS_SPELLED.search(now):
        mapped = undo_spelling(mapped or Mapped(text))
        now = mapped.text
    if (b"dot" in words or any(c in now for c in "@[({<")) and _SIGNS.search(now):
        mapped = undo_signs(mapped or Mapped(text))
    if mapped is None or mapped.text == text:
        return []
    found = find_plain(mapped.text)
    for run in re.finditer(r"(?<![0-9+])[0-9]{10,15}(?![0-9])", mapped.text):  # wholly spelled numbers
        if mapped.ends[run.end() - 1] - mapped.starts[run.start()] >= 3 * len(run[0]):
            found.append(("phone", run.start(), run.end()))
    out = []
    for kind, start, end in found:
        a, b = mapped.source(start, end)
        if text[a:b] != mapped.text[start:end] and not any(s < b and a < e for _, s, e in (*plain, *out)):
            out.append((kind, a, b))
    return out


def scan_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Personal data of every text: ``spans`` (kind, start, end in code points, text, plain), in the
    order of kind and start; ``plain`` is false for what was found in disguise.

    One row for each row of ``docs``, in one pass without a shuffle. A null text counts as empty
    and has no spans; rows that repeat are each scanned; a null id stays null; other columns are not read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()),
                      ("plain", pa.bool_())])

    def run(texts: list[bytes]) -> list[pa.Array]:
        rows = []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            plain = find_plain(text)
            both = [(*s, True) for s in plain] + [(*s, False) for s in find_disguised(text, plain)]
            both.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
            rows.append([{"kind": k, "start": a, "end": b, "text": text[a:b], "plain": p} for k, a, b, p in both])
        return [pa.array(rows, pa.list_(span))]

    return per_text(
        docs, id_column, text_column, run,
        "spans array<struct<kind:string,start:bigint,end:bigint,text:string,plain:boolean>>",
    )


def joined_spans(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(scanned: DataFrame) -> DataFrame:
    plain = F.filter("spans", lambda s: s["plain"])
    count = lambda kind: F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.sha2(joined_spans(plain).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
