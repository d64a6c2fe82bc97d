"""The query language: a tree of frozen nodes and a recursive-descent parser.

    either   := both { OR both }
    both     := not { [AND] not | NOT not }          adjacent words and groups are ANDed
    not      := NOT not | ( either ) | atom
    atom     := "phrase" | ~term[:threshold] | level:X | severity:X | field:value | word

Keywords are upper case. A query that is /pattern/flags as a whole, or is flagged as one, is a regular
expression; one that is not valid is searched for literally.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    term: str


@dataclass(frozen=True)
class Phrase:
    phrase: str

    @property
    def terms(self) -> list[str]:
        return self.phrase.lower().split()


@dataclass(frozen=True)
class Regex:
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Fuzzy:
    term: str
    threshold: float = 0.85


@dataclass(frozen=True)
class Level:
    level: str


@dataclass(frozen=True)
class Field:
    field: str
    value: str


@dataclass(frozen=True)
class Range:
    field: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Node = Term | Phrase | Regex | Fuzzy | Level | Field | Range | And | Or | Not
#: A quoted phrase, also after a field's colon; a parenthesis; or a run of other characters.
_LEXEME = re.compile(r'\s*("[^"]*"|[()]|(?:[^\s()":]+:)?"[^"]*"|[^\s()"]+|")')


def valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def parse(query: str, ignore_case: bool = True, is_regex: bool = False, strict: bool = False) -> Node:
    """strict: adjacent words make one term, spaces included, instead of being ANDed."""
    case = "i" if ignore_case else ""
    if is_regex:
        return Regex(query if valid(query) else re.escape(query), case)
    whole = re.fullmatch(r"/(.+)/([gimsuy]*)", query.strip())
    if whole and valid(whole[1]):
        return Regex(whole[1], case + "".join(f for f in whole[2] if f in "ms"))
    return _Parser(query, strict).parse()


class _Parser:
    def __init__(self, query: str, strict: bool):
        self.query, self.strict = query, strict
        self.lexemes = _LEXEME.findall(query)
        self.at = 0

    def peek(self) -> str | None:
        return self.lexemes[self.at] if self.at < len(self.lexemes) else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def parse(self) -> Node:
        node = self.either()
        while self.peek() is not None:  # an unmatched closing parenthesis does not end the query
            self.at += 1
            if self.peek() not in (None, ")"):
                node = And((node, self.either()))
        return node

    def either(self) -> Node:
        parts = [self.both()]
        while self.take("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def both(self) -> Node:
        parts = [self.negated()]
        while self.peek() not in (None, ")", "OR"):
            joined = self.take("AND")
            if self.strict and not joined and self.peek() not in ("NOT", "(") and isinstance(parts[-1], Term):
                parts[-1] = Term(f"{parts[-1].term} {self.lexemes[self.at].lower()}")
                self.at += 1
            else:
                parts.append(self.negated())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negated(self) -> Node:
        if self.take("NOT"):
            return Not(self.negated())
        if self.take("("):
            node = self.either()
            self.take(")")
            return node
        lexeme = self.peek()
        self.at += 1
        return atom(lexeme or "")


def atom(text: str) -> Node:
    if len(text) > 2 and text[0] == text[-1] == '"':
        words = text[1:-1].split()
        return Term(words[0].lower()) if len(words) == 1 else Phrase(text[1:-1])
    if text.startswith("~") and len(text) > 1:
        term, colon, number = text[1:].rpartition(":")
        if colon and re.fullmatch(r"[0-9]*\.?[0-9]+", number) and 0 <= float(number) <= 1:
            return Fuzzy(term.lower(), float(number))
        return Fuzzy(text[1:].lower())
    name, colon, value = text.partition(":")
    if colon and name and value:
        value = value.strip().removeprefix('"').removesuffix('"')
        return Level(value.upper()) if name.lower() in ("level", "severity") else Field(name.lower(), value)
    return Term(text.lower())


def terms(node: Node) -> list[str]:
    """Terms to score and highlight, in the order of the query, those under NOT included."""
    match node:
        case Term(term) | Fuzzy(term):
            return [term]
        case Phrase():
            return node.terms
        case Level(level):
            return [level.lower()]
        case Field(_, value):
            return [value.lower()]
        case And(parts) | Or(parts):
            return [t for p in parts for t in terms(p)]
        case Not(part):
            return terms(part)
    return []
