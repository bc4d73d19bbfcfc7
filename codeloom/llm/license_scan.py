"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags; the
expression behind a tag is put in postfix order by a shunting-yard and evaluated."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

# Phrases of the contract: words that stand one after the other, and their label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notices beyond the contract.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
# Labels of identifiers that name a licence of the phrases.
LABEL_OF = {"apache-2.0": "apache-2", "cc-by-nc-3.0": "cc-by-nc", "cc-by-nc-4.0": "cc-by-nc"}
ALLOWED = ("mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "public-domain", "cc0-1.0", "unlicense")
# How sure one kind of evidence makes it that the text states its licence.
WEIGHTS = {"base": 0.9, "tag": 0.95, "notice": 0.6}

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TAG_PLACE = re.compile(rb"spdx[\x00-\x2f\x3a-\x60\x7b-\x7f]+license[\x00-\x2f\x3a-\x60\x7b-\x7f]+identifier[ \t]*:")
TOKEN = re.compile(rb"[ \t]*(\(|\)|[0-9a-z][0-9a-z.+-]*)")

FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, bad_expressions long, usable boolean"
)


def label_of(identifier: str) -> str:
    return LABEL_OF.get(identifier, identifier)


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Tokens in postfix order, or None if they are no expression."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last token ended an operand
    for token in tokens:
        if token == "(":
            if operand:
                return None
            waiting.append(token)
        elif token == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif token in PRECEDENCE:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand = False
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str]) -> tuple[set[str], bool] | None:
    """All labels of an expression, and whether a user may choose licences so that all
    that hold are allowed. An exception only adds permission."""
    stack: list[tuple[set[str], bool, str]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(({label_of(token)}, label_of(token) in allowed, token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            if not left[2] or not right[2]:
                return None  # it joins one licence and one exception
            name = f"{label_of(left[2])}-with-{right[2]}"
            stack.append(({name}, left[1] or name in allowed, ""))
        else:
            few, many = sorted((left[0], right[0]), key=len)
            many |= few  # into the larger one, so that long expressions stay cheap
            stack.append((many, left[1] or right[1] if token == "or" else left[1] and right[1], ""))
    return stack[0][0], stack[0][1]


def read_expression(text: bytes, at: int) -> list[str]:
    """Tokens from ``at`` on that may belong to one expression of this line. Reading ends
    where an identifier follows an operand, as in prose."""
    tokens: list[str] = []
    operand, depth = False, 0
    while found := TOKEN.match(text, at):
        token = found[1].decode()
        if operand and token != ")" and token not in PRECEDENCE or token == ")" and depth == 0:
            break
        depth += (token == "(") - (token == ")")
        operand = token == ")" or token != "(" and token not in PRECEDENCE
        if operand and token != ")":
            token = token.rstrip(".") or token
        tokens.append(token)
        at = found.end()
    return tokens


def scanner(base: dict[str, str], notices: dict[str, str], allowed: tuple[str, ...]) -> Callable[[], Callable]:
    def start() -> Callable:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
        for kind, phrases in (("notice", notices), ("base", base)):
            for phrase, label in phrases.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for phrase, found in kinds.items():
            automaton.add_word(f" {phrase} ", (len(phrase.split()), found))
        automaton.make_automaton()
        allows = frozenset(allowed)
        # A-Z to a-z, what is no part of a word to a space, the rest as it is.
        word = b"0123456789abcdefghijklmnopqrstuvwxyz"
        table = bytes(b if b in word or b >= 0x80 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

        def scan(text: bytes | None) -> tuple:
            words = (text or b"").translate(table).split()
            line = b" " + b" ".join(words) + b" "
            n_base, first, last = 0, None, None
            base_labels: set[str] = set()
            labels: set[str] = set()
            seen: set[str] = set()
            plain: set[str] = set()
            upto = word_at = 0
            for end, (length, found) in automaton.iter(line.decode("latin-1")):
                word_at += line.count(b" ", upto, end)  # spaces before the last one of the match
                upto = end
                begin = word_at - length
                for kind, label in found:
                    seen.add(kind)
                    if kind == "base":
                        n_base += 1
                        first = begin if first is None else min(first, begin)
                        last = begin if last is None else max(last, begin)
                        base_labels.add(label)
                    if kind != "tag":
                        labels.add(label)
                        plain.add(label)
            usable = all(x in allows for x in plain) if plain else None
            expressions, bad = [], 0
            if "tag" in seen:
                seen.discard("tag")
                lower = text.lower()
                for place in TAG_PLACE.finditer(lower):
                    tokens = read_expression(lower, place.end())
                    postfix = to_postfix(tokens)
                    value = evaluate(postfix, allows) if postfix else None
                    if value is None:
                        bad += 1
                        continue
                    seen.add("tag")
                    expressions.append(" ".join(tokens))
                    labels |= value[0]
                    usable = value[1] if usable is None else usable and value[1]
            doubt = 1.0
            for kind in sorted(seen):
                doubt *= 1 - WEIGHTS[kind]
            return (
                len(words), n_base, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                1 - doubt, expressions, bad, usable,
            )

        names = [f.split()[0] for f in FIELDS.split(", ")]

        def compute(texts: list) -> dict:
            return dict(zip(names, map(list, zip(*map(scan, texts), strict=True)), strict=True))

        return compute

    return start


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """Licences that each text names, beside the ``keep`` columns (all, if None).

    ``n_words``: words, i.e. runs of digits, letters and all beyond ASCII, A-Z lowered.
    ``n_base``, ``first_word``, ``last_word``, ``base_labels``: places of the ``base``
    phrases (overlapping ones all count), smallest and largest start (null if none) and
    their labels. ``labels``: these, those of ``notices`` and of valid expressions behind
    ``SPDX-License-Identifier:``. ``expressions``: these, lowered; ``bad_expressions``: tags
    without a valid one. ``usable``: whether all notices are allowed and each expression
    can be met by allowed licences; null if the text names none. ``score``: how sure it is
    that the text states a licence (0: nothing found).

    A null text is an empty one: no words, empty labels, score 0. Repeated rows give
    repeated rows; a kept column with the name of a result is replaced. One pass, no shuffle.
    """
    from codeloom.llm.common import map_rows

    return map_rows(docs, text, FIELDS, scanner(base, notices, allowed), keep)
