"""License scan: Aho-Corasick over word streams and a shunting-yard expression parser.

Texts become words (ASCII letters and digits and everything beyond ASCII, A-Z
lower-cased) joined by single spaces; one pass of the automaton finds all notice phrases
and identifier tags.  Where a tag is met the original text behind it is parsed as a
licence expression with ``AND``, ``OR``, ``WITH`` and parentheses and evaluated against
the permissive licences.

Cases: null texts count as empty; malformed expressions keep the identifiers read up to
the fault and evaluate to not permitted; repeated rows are each returned; places that begin
or end together are all counted; extra columns are ignored; a text is scanned in time that
grows with its length, whatever it repeats; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import blocks
from .workspace import small_batches

# Phrases of licence notices and the label that each one gives.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc0 1 0": "cc0-1.0",
    "released into the public domain": "public-domain",
}
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib"}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\n\r]*)")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
BINDING = {"or": 1, "and": 2, "with": 3}

_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def word_bytes(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators of an expression in postfix order."""
    out: list[str] = []
    held: list[str] = []
    operand = False
    for token in (t.lower() for t in TOKEN.findall(expression)):
        if token in BINDING:
            if not operand:
                break
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[token]:
                out.append(held.pop())
            held.append(token)
            operand = False
        elif token == "(":
            if operand:
                break
            held.append(token)
        elif token == ")":
            if not operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif operand:
            break
        else:
            out.append(token)
            operand = True
    if not operand and held:
        held.append("!")  # an operator without its second operand: a fault
    return out + [h for h in reversed(held) if h != "("]


def evaluate(rpn: list[str]) -> tuple[list[str], bool]:
    """Identifiers of an expression and whether its terms permit free use."""
    stack: list[bool] = []
    ids: list[str] = []
    sound = bool(rpn)
    exceptions = set()
    for token in rpn:
        if token in BINDING:
            if len(stack) < 2:
                sound = False
                break
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if token == "or" else a and b if token == "and" else a)
            if token == "with":
                exceptions.add(ids[-1])
        elif token == "!":
            sound = False
        else:
            ids.append(token)
            stack.append(token.rstrip("+") in PERMISSIVE)
    return [i for i in ids if i not in exceptions], sound and stack[-1:] == [True]


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for phrase in sorted({*BASE_PHRASES, *NOTICE_PHRASES, TAG}):
        auto.add_word(f" {phrase} ", phrase)
    auto.make_automaton()
    return auto


def scan_text(auto: ahocorasick.Automaton, text: str) -> tuple:
    words = word_bytes(text)
    joined = " " + b" ".join(words).decode("latin-1") + " "
    base: list[tuple[str, int]] = []
    more: set[str] = set()
    notices, tagged = 0, False
    counted = words_before = 0  # hits come by their ends, so each stretch is counted once
    for end, phrase in auto.iter(joined):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE_PHRASES:
            words_before += joined.count(" ", counted, end)
            counted = end
            base.append((BASE_PHRASES[phrase], words_before - phrase.count(" ") - 1))
        else:
            notices += 1
            more.add(NOTICE_PHRASES[phrase])
    expressions, permitted = [], None
    for line in TAG_LINE.findall(text) if tagged else ():
        ids, ok = evaluate(postfix(line))
        if ids:
            more.update(ids)
            expressions.append(" ".join(postfix(line)))
            permitted = ok if permitted is None else permitted and ok
    at = [a for _, a in base]
    labels = {b for b, _ in base}
    score = 1 - 0.1 ** len(expressions) * 0.3 ** min(notices, 20) * 0.4 ** min(len(base), 20)
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), score, expressions, permitted


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: word and phrase counts and places, labels, score, expressions (postfix) and whether they permit free use."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [("n_words", pa.int64(), "long"), ("n_base", pa.int64(), "long"), ("first_word", pa.int64(), "long"), ("last_word", pa.int64(), "long"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"), ("score", pa.float64(), "double"), ("expressions", pa.list_(pa.string()), "array<string>"), ("permitted", pa.bool_(), "boolean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for block in blocks(batches, "text"):
            rows = [scan_text(auto, t or "") for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(kinds))], ["doc_id", *(n for n, _, _ in kinds)])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, " + ", ".join(f"{n} {s}" for n, _, s in kinds))
