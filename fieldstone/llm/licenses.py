"""Licence scans: an Aho-Corasick automaton finds identifier tags and notice phrases in the words
of a text, and a shunting-yard parser evaluates the licence expressions behind the tags."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldstone.llm.text import per_text, terms

# The phrases whose places are counted, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices, with the weight of the evidence.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "bsd license": ("bsd", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("proprietary", 0.5),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.7),
    "without warranties or conditions of any kind": ("apache", 0.5),
}
TAGS = ("spdx license identifier", "license expression", "license identifier")
# Families of licence identifiers: prefix, label, and whether derived works may be closed.
FAMILIES = (
    ("agpl", "agpl", False), ("lgpl", "lgpl", False), ("gpl", "gpl", False), ("apache", "apache", True),
    ("mit", "mit", True), ("bsd", "bsd", True), ("mpl", "mpl", False), ("epl", "epl", False),
    ("bsl", "bsl", True), ("isc", "isc", True), ("cc-by-nc-nd", "cc-by-nc-nd", False),
    ("cc-by-nc-sa", "cc-by-nc-sa", False), ("cc-by-nc", "cc-by-nc", False), ("cc-by-sa", "cc-by-sa", False),
    ("cc-by-nd", "cc-by-nd", False), ("cc-by", "cc-by", True), ("cc0", "cc0", True), ("unlicense", "unlicense", True),
)
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_LINE = re.compile(rb"[^\r\n]*")
_TAG_TEXT = re.compile(rb"(?i)(?:spdx-license-identifier|license[ -]expression|license[ -]identifier)[\"']?\s*[:=]\s*[\"']?")


def postfix(expression: str) -> list[str] | None:
    """Licence expression to postfix order; None if it isn't one."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what may come next
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand = True
        elif word == "(":
            if not operand:
                return None
            stack.append(word)
        elif word == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif not operand:  # prose after the expression ends it
            break
        else:
            out.append(token)
            operand = False
    while stack:
        top = stack.pop()
        if top == "(":
            return None
        out.append(top)
    return out if out and not operand else None


def family(identifier: str) -> tuple[str, bool]:
    low = identifier.lower()
    return next(((label, free) for prefix, label, free in FAMILIES if low.startswith(prefix)), ("other", False))


def evaluate(rpn: list[str]) -> tuple[list[str], bool]:
    """The labels an expression names, and whether some choice of it is permissive throughout.

    ``and`` needs both sides, ``or`` either, ``with`` keeps its left side: an exception only adds leave.
    """
    stack: list[tuple[frozenset, bool]] = []
    for item in rpn:
        if item in _RANK:
            right, left = stack.pop(), stack.pop()
            if item == "with":
                stack.append(left)
            else:
                free = (left[1] and right[1]) if item == "and" else (left[1] or right[1])
                stack.append((left[0] | right[0], free))
        else:
            label, free = family(item)
            stack.append((frozenset([label]), free))
    return sorted(stack[0][0]), stack[0][1]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found: dict[str, tuple] = {}
    for phrase, (label, weight) in NOTICES.items():
        found[phrase] = ("notice", label, weight)
    for phrase in TAGS:
        found[phrase] = ("tag", "", 0.0)
    for phrase, label in BASE.items():
        found[phrase] = ("base", label, 0.9)
    machine = ahocorasick.Automaton()
    for phrase, (kind, label, weight) in found.items():
        machine.add_word(f" {phrase} ", (kind, label, weight, phrase))
    machine.make_automaton()
    return machine


_HIT = pa.struct([("kind", pa.string()), ("label", pa.string()), ("word", pa.int64()), ("text", pa.string()),
                  ("weight", pa.float64())])
_EXPRESSION = pa.struct([("text", pa.string()), ("valid", pa.bool_()), ("labels", pa.list_(pa.string())),
                         ("permissive", pa.bool_())])


def scan_text(text: bytes) -> tuple[int, list[dict], list[dict]]:
    """(number of words, hits by place, expressions) of one text."""
    words = terms(text)
    line = b" ".join((b"", *words, b"")).decode("latin-1")
    hits, tagged = [], False
    at = word = 0
    for end, (kind, label, weight, phrase) in _automaton().iter(line):
        start = end - len(phrase) - 1
        word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
        at = start
        tagged |= kind == "tag"
        hits.append({"kind": kind, "label": label, "word": word, "text": phrase, "weight": weight})
    expressions = []
    if tagged:
        for m in _TAG_TEXT.finditer(text):
            said = _LINE.match(text, m.end())[0].decode("utf-8", "replace").strip()
            rpn = postfix(said)
            labels, free = evaluate(rpn) if rpn else ([], False)
            expressions.append({"text": said, "valid": rpn is not None, "labels": labels, "permissive": free})
    hits.sort(key=lambda h: (h["word"], h["text"]))
    return len(words), hits, expressions


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Licence evidence of every text: ``n_words``, ``hits`` (kind, label, word, text, weight) and
    ``expressions`` (text, valid, labels, permissive).

    One row for each row of ``docs``, in one pass without a shuffle. A null text counts as empty
    and has no hits; rows that repeat are each scanned; a null id stays null; other columns are not read.
    """

    def run(texts: list[bytes]) -> list[pa.Array]:
        found = [scan_text(t) for t in texts]
        return [
            pa.array([x[0] for x in found], pa.int64()),
            pa.array([x[1] for x in found], pa.list_(_HIT)),
            pa.array([x[2] for x in found], pa.list_(_EXPRESSION)),
        ]

    return per_text(
        docs, id_column, text_column, run,
        "n_words long, hits array<struct<kind:string,label:string,word:bigint,text:string,weight:double>>, "
        "expressions array<struct<text:string,valid:boolean,labels:array<string>,permissive:boolean>>",
    )


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, places, labels and the strength of the evidence (a noisy-or of its weights)."""
    base = F.filter("hits", lambda h: h["kind"] == "base")
    stated = F.flatten(F.transform("expressions", lambda e: e["labels"]))
    named = F.concat(F.transform(F.filter("hits", lambda h: h["kind"] != "tag"), lambda h: h["label"]), stated)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    doubt = F.aggregate("hits", F.lit(1.0), lambda a, h: a * (1 - h["weight"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["word"])).alias("last_word"),
        joined(F.transform(base, lambda h: h["label"])).alias("base_labels"),
        joined(named).alias("labels"),
        (1 - doubt * F.when(F.exists("expressions", lambda e: e["valid"]), 0.05).otherwise(1.0)).alias("score"),
        F.exists("expressions", lambda e: e["permissive"]).alias("permissive"),
    )
