"""Licence scans: Aho-Corasick over tags and notice phrases, shunting-yard for expressions.

Two automata are built once per task.  Phrases are sought in the text's words
(A-Z lower-cased, joined by one space), so that a phrase matches wherever its
words stand consecutively.  Identifier tags are sought in the lower-cased raw
text; what follows a tag up to the end of its line is read as a licence
expression: identifiers, ``and``, ``or``, ``with`` and parentheses, with
``with`` binding tightest and ``or`` loosest.  An expression evaluates to its
alternatives, each a set of licences that hold together.

Labels: of every phrase found, and of the licences of the best alternative
(fewest licences, then by name) of every expression that parses; that one is
found without listing the others.  Base phrases keep their labels whatever else is found.

Defined results: a null text is empty, without words or labels; text after a
tag that is no expression adds nothing; overlapping phrases all count; repeated
ids are scanned row by row; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

#: Phrases of the contract and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notice phrases of this method.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Identifier families: prefix of an identifier and the label it gets.
FAMILIES = (
    ("agpl-", "agpl"), ("lgpl-", "lgpl"), ("gpl-", "gpl"), ("apache-", "apache"), ("mit", "mit"), ("bsd-", "bsd"), ("mpl-", "mpl"),
    ("cc-by", "cc-by"), ("cc0-", "cc0"), ("epl-", "epl"), ("isc", "isc"), ("unlicense", "unlicense"), ("zlib", "zlib"),
)
#: Identifiers that versions or variants follow behind a hyphen.
HYPHENATED = ("cc-by", "mit")
RANK = {"or": 1, "and": 2, "with": 3}
LINE = re.compile(r"[^\r\n]*")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+\-:]*")


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard; None for what is no expression."""
    out: list[str] = []
    held: list[str] = []
    operand = True
    for tok in tokens:
        if operand:
            if tok == "(":
                held.append(tok)
            elif tok in RANK or tok == ")":
                return None
            else:
                out.append(tok)
                operand = False
        elif tok == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif tok in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[tok]:
                out.append(held.pop())
            held.append(tok)
            operand = True
        else:
            return None
    if operand or "(" in held:
        return None
    return out + held[::-1]


def minimal(sets: set[frozenset[str]]) -> list[frozenset[str]]:
    """Without those that hold another one: they are never the best choice."""
    kept: list[frozenset[str]] = []
    for x in sorted(sets, key=lambda s: (len(s), sorted(s))):
        if not any(k <= x for k in kept):
            kept.append(x)
    return kept


def alternatives(expression: str) -> list[frozenset[str]] | None:
    """Smallest sets of licences that satisfy the expression, the best one first.

    ``a with e`` is one licence.  All sets are listed, so this is for short
    expressions; ``best_alternative`` finds the first one of any.
    """
    tokens = TOKEN.findall(expression.lower())
    postfix = to_postfix(tokens)
    if postfix is None:
        return None
    stack: list[list[frozenset[str]]] = []
    for tok in postfix:
        if tok not in RANK:
            stack.append([frozenset([tok])])
            continue
        right, left = stack.pop(), stack.pop()
        if tok == "or":
            made = {*left, *right}
        elif tok == "and":
            made = {a | b for a in left for b in right}
        elif len(left) == len(right) == len(left[0]) == len(right[0]) == 1:
            made = {frozenset([f"{min(left[0])} with {min(right[0])}"])}
        else:
            return None
        stack.append(minimal(made))
    return stack[0]


def joined(op: str, a, b):
    """``a op b`` as (op, parts); an identifier is a string, and parts of the same kind are merged."""
    parts = frozenset().union(*(x[1] if isinstance(x, tuple) and x[0] == op else (x,) for x in (a, b)))
    return (op, parts) if len(parts) > 1 else next(iter(parts))


def given(node, name: str, value: bool):
    """What is left of the expression once a licence is taken or ruled out; True or False if nothing."""
    if isinstance(node, str):
        return value if node == name else node
    op, parts = node
    settles, out = op == "or", None
    for x in parts:
        x = given(x, name, value)
        if x is settles:
            return settles
        if not isinstance(x, bool):
            out = x if out is None else joined(op, out, x)
    return (not settles) if out is None else out


def licences_of(node) -> Counter:
    return Counter([node]) if isinstance(node, str) else sum((licences_of(x) for x in node[1]), Counter())


def smallest(node, known: dict) -> frozenset[str]:
    """The set of fewest licences, then the first by name, that satisfies the expression.

    Parts of an "and" that share no licence are settled one by one; within those
    that do, the licence that occurs most is taken or ruled out.
    """
    if isinstance(node, str):
        return frozenset([node])
    if node not in known:
        op, parts = node
        if op == "or":
            best = min((smallest(x, known) for x in parts), key=order)
        else:
            groups: list[tuple[set[str], list]] = []
            for x in parts:
                names, members = set(licences_of(x)), [x]
                apart = []
                for g in groups:
                    if g[0] & names:
                        names |= g[0]
                        members += g[1]
                    else:
                        apart.append(g)
                groups = [*apart, (names, members)]
            if len(groups) > 1:
                best = frozenset().union(*(smallest(m[0] if len(m) == 1 else ("and", frozenset(m)), known) for _, m in groups))
            else:
                name = min(licences_of(node).items(), key=lambda x: (-x[1], x[0]))[0]
                with_it, without = given(node, name, True), given(node, name, False)
                found = [frozenset([name]) if with_it is True else smallest(with_it, known) | {name}]
                if without is not False:
                    found.append(smallest(without, known))
                best = min(found, key=order)
        known[node] = best
    return known[node]


def order(names: frozenset[str]):
    return len(names), sorted(names)


def best_alternative(expression: str) -> frozenset[str] | None:
    """The first of ``alternatives``, found without listing them, however many there are."""
    postfix = to_postfix(TOKEN.findall(expression.lower()))
    if postfix is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 4 * len(postfix)))  # no deeper than its operators
    stack: list = []
    for tok in postfix:
        if tok not in RANK:
            stack.append(tok)
            continue
        right, left = stack.pop(), stack.pop()
        if tok == "with":
            sides = [smallest(x, {}) for x in (left, right)]
            if any(len(s) > 1 or given(x, min(s), False) is not False for x, s in zip((left, right), sides)):
                return None
            stack.append(f"{min(sides[0])} with {min(sides[1])}")
        else:
            stack.append(joined(tok, left, right))
    return smallest(stack[0], {})


def family(identifier: str) -> str | None:
    """Label of an identifier: of its family, its own name for ``licenseref-``, else none."""
    base = identifier.split(" with ")[0].removesuffix("+")
    for prefix, label in FAMILIES:
        if base == prefix or (prefix.endswith("-") and base.startswith(prefix)) or base.startswith(prefix + "-") and prefix in HYPHENATED:
            return label
    return base if base.startswith("licenseref-") else None


class Scanner:
    """Automata for phrases and tags; a key is the phrase between single spaces."""

    def __init__(self) -> None:
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            self.phrases.add_word(f" {phrase} ", (phrase, label))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()
        self.lower = B.LOWER.tobytes()
        blank = B.LOWER.copy()
        blank[B.PUNCT & ~_upper()] = 32
        self.flat = blank.tobytes()

    def scan(self, raw: bytes) -> dict:
        words = raw.translate(self.flat).split()
        flat = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace") if words else ""
        base, labels, starts, score = set(), set(), [], 0.0
        for end, (phrase, label) in self.phrases.iter(flat):
            labels.add(label)
            score = max(score, 0.8)
            if phrase in BASE:
                base.add(label)
                starts.append(end + 1 - len(phrase) - 2)
                score = 1.0
        places = _word_index(flat, starts)
        expressions = []
        text = raw.translate(self.lower).decode("utf-8", "replace")
        for end, _ in self.tags.iter(text):
            line = LINE.match(text, end + 1)[0]
            found = best_alternative(line)
            if found:
                expressions.append(line.strip())
                labels |= {family(x) for x in found} - {None}
                score = max(score, 0.95)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": places[0] if places else None, "last_word": places[-1] if places else None,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels | base)), "score": score, "expressions": expressions,
        }


def _upper() -> np.ndarray:
    t = np.zeros(256, bool)
    t[65:91] = True
    return t


def _word_index(flat: str, starts: list[int]) -> list[int]:
    """Number of the word that begins behind the space at each start."""
    out, at, count = [], 0, 0
    for s in sorted(starts):
        count += flat.count(" ", at, s)
        at = s
        out.append(count)
    return out


KIND = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"


def scan_batches(batches):
    scanner = Scanner()
    schema = pa.schema([
        ("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())),
    ])
    for batch in batches:
        data, off = B.column_bytes(batch.column(1))
        ids = batch.column(0).to_pylist()
        rows = [{"id": ids[r], **scanner.scan(data[off[r] : off[r + 1]].tobytes())} for r in range(len(batch))]
        yield pa.RecordBatch.from_pylist(rows, schema)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with places, labels, score and the expressions found."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan_batches, KIND)


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """The query: every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).drop("expressions").withColumnRenamed("id", "doc_id")
