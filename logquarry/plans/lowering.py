"""Queries to plans: a Column over tokenised lines, or candidate lines from postings that the Column rechecks.

The scan needs no shuffle and suits a single search. The index reads only the postings of the query's
terms (they are clustered by term, so Parquet statistics skip the rest), needs one shuffle by line whatever
the depth of the tree, and fetches only candidate lines.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import may_reach, similar_in, similarity
from ..functions.text import number, quoted
from ..functions.tokens import MIN_LENGTH, STOP_WORDS
from .query import And, Field, Fuzzy, Level, Node, Not, Or, Phrase, Range, Regex, Term


def java_pattern(node: Regex) -> str:
    flags = "".join(sorted(set(node.flags) & set("ims")))
    return (f"(?{flags})" if flags else "") + node.pattern


def term_bounds(term: str, content: Column, stop_words: list[str] | None = None) -> tuple[Column, Column]:
    """What a line with a term always has, and what only a line with the term has; without tokenising.

    A term never stands beside a word character, and a token between characters of no token is its own term.
    Lines between the two, as those with a full stop after the word, are few.
    """
    if not re.fullmatch(r"[a-z0-9_.\-/]+", term):
        return F.lit(False), F.lit(False)
    literal = quoted(term)
    bounded = content.rlike("(?i)" + (r"(?<!\w)" if re.match(r"\w", term) else "") + literal + (r"(?!\w)" if re.search(r"\w$", term) else ""))
    plain = len(term) >= MIN_LENGTH and re.search(r"\w", term) and term not in [w.lower() for w in [*STOP_WORDS, *(stop_words or [])]]
    return bounded, content.rlike(rf"(?i)(?<![\w.\-/]){literal}(?![\w.\-/])") if plain else F.lit(False)


def bounds(node: Node, stop_words: list[str] | None = None) -> tuple[Column, Column]:
    """Conditions on ``content`` that every match keeps, and that only matches keep (mode "token")."""
    both = lambda parts, join: tuple(reduce(join, side) for side in zip(*(bounds(p, stop_words) for p in parts), strict=True))
    match node:
        case Term(term):
            return term_bounds(term, F.col("content"), stop_words)
        case Level(value) | Field(_, value):
            return term_bounds(value.lower(), F.col("content"), stop_words)
        case And(parts):
            return both(parts, lambda a, b: a & b)
        case Or(parts):
            return both(parts, lambda a, b: a | b)
        case Not(part):
            above, below = bounds(part, stop_words)
            return ~below, ~above
        case Fuzzy():
            return F.lit(True), F.lit(False)
    exact = predicate(node)
    return exact, exact


def is_fuzzy(node: Node) -> bool:
    match node:
        case And(parts) | Or(parts):
            return any(map(is_fuzzy, parts))
        case Not(part):
            return is_fuzzy(part)
    return isinstance(node, Fuzzy)


def predicate(node: Node, mode: str = "token", found: Column | None = None) -> Column:
    """Boolean over column ``content`` and the line's terms: column ``terms`` or ``found``.

    mode "column" compares levels and fields with parsed columns.
    """
    content, found = F.col("content"), F.col("terms") if found is None else found
    has = lambda term: F.array_contains(found, term)
    match node:
        case Term(term):
            return has(term)
        case Phrase(phrase):
            return F.contains(F.lower(content), F.lit(phrase.lower()))
        case Regex():
            return content.rlike(java_pattern(node))
        case Fuzzy(term, threshold):
            return similar_in(found, term, threshold)
        case Level(level):
            return F.coalesce(F.upper(F.col("level")) == level, F.lit(False)) if mode == "column" else has(level.lower())
        case Field(field, value):
            return F.coalesce(F.lower(F.col(field).cast("string")) == value.lower(), F.lit(False)) if mode == "column" else has(value.lower())
        case Range(field, low, high):
            return F.coalesce(number(content, field).between(F.lit(float("-inf") if low is None else float(low)), F.lit(float("inf") if high is None else float(high))), F.lit(False))
        case And(parts):
            return reduce(lambda a, b: a & b, (predicate(p, mode, found) for p in parts))
        case Or(parts):
            return reduce(lambda a, b: a | b, (predicate(p, mode, found) for p in parts))
        case Not(part):
            return ~predicate(part, mode, found)
    raise TypeError(node)


def phrase_candidates(node: Phrase) -> Column:
    """The weaker reading of a phrase: all of its terms, in any order."""
    return reduce(lambda a, b: a & b, (F.array_contains(F.col("terms"), t) for t in node.terms))


class Candidates:
    """What the postings say of a tree: leaves by number, and a condition that every match keeps."""

    def __init__(self, node: Node):
        self.leaves: list[Term | Fuzzy] = []
        self.condition = self.necessary(node)

    def leaf(self, node: Term | Fuzzy):
        if node not in self.leaves:
            self.leaves.append(node)
        at = self.leaves.index(node)
        return lambda flags: flags[at]

    def necessary(self, node: Node):
        """A function of the leaves' flags (Columns or booleans)."""
        match node:
            case Term() | Fuzzy():
                return self.leaf(node)
            case Level(level):
                return self.leaf(Term(level.lower()))
            case Field(_, value):
                return self.leaf(Term(value.lower()))
            case Phrase():
                # the ends of a phrase may lie inside longer tokens; only its inner words are tokens of the line for certain
                inner = [t for t in node.terms[1:-1] if t.isalnum() and t.isascii() and len(t) >= MIN_LENGTH and t not in STOP_WORDS]
                return self.all([self.leaf(Term(t)) for t in inner])
            case And(parts):
                return self.all([self.necessary(p) for p in parts])
            case Or(parts):
                made = [self.necessary(p) for p in parts]
                return lambda flags: reduce(lambda a, b: a | b, (m(flags) for m in made))
            case Not(Term() as part):
                own = self.leaf(part)
                return lambda flags: negated(own(flags))
        return lambda flags: true(flags)

    @staticmethod
    def all(made):
        return lambda flags: reduce(lambda a, b: a & b, (m(flags) for m in made), true(flags))

    @property
    def indexable(self) -> bool:
        """Whether a line with none of the leaves' terms is never a match."""
        return bool(self.leaves) and not self.condition([False] * len(self.leaves))


def decided(node: Node) -> bool:
    """Whether the postings alone say which lines match, so that no line need be read again."""
    match node:
        case Term() | Fuzzy() | Level() | Field():
            return True
        case And(parts) | Or(parts):
            return all(map(decided, parts))
        case Not(part):
            return isinstance(part, Term)
    return False


def true(flags):
    return F.lit(True) if flags and isinstance(flags[0], Column) else True


def negated(flag):
    return ~flag if isinstance(flag, Column) else not flag


def index_hits(node: Node, postings: DataFrame, vocabulary: DataFrame) -> DataFrame | None:
    """Candidate lines (file, line_no) by the postings; None if the tree needs a scan."""
    plan = Candidates(node)
    if not plan.indexable:
        return None
    exact = sorted({leaf.term for leaf in plan.leaves if isinstance(leaf, Term)})
    rows = postings.where(F.col("term").isin(exact)).select("file", "line_no", *(((F.col("term") == leaf.term) if isinstance(leaf, Term) else F.lit(False)).alias(f"h{i}") for i, leaf in enumerate(plan.leaves)))
    for i, leaf in enumerate(plan.leaves):
        if isinstance(leaf, Fuzzy):  # similarity is computed once for each term of the vocabulary
            near = vocabulary.where(may_reach(F.col("term"), leaf.term, leaf.threshold)).where(similarity(F.col("term"), leaf.term) >= leaf.threshold)
            hits = postings.join(near.select("term"), "term", "left_semi")
            rows = rows.unionByName(hits.select("file", "line_no", *(F.lit(k == i).alias(f"h{k}") for k in range(len(plan.leaves)))))
    flags = [F.col(f"h{i}") for i in range(len(plan.leaves))]
    return rows.groupBy("file", "line_no").agg(*(F.max(f).alias(f"h{i}") for i, f in enumerate(flags))).where(plan.condition(flags)).select("file", "line_no")
