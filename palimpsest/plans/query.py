"""The query language: text to a tree of groups.

Terms are joined by AND, OR and NOT in any case, strictly from left to right
inside a pair of parentheses; terms side by side are joined by OR. A term
stands for all words that begin with it, a quoted term for itself. Only the
first group at the top counts.

The reading rules, all of which a query can show: letters are folded like
those of a text, any other character separates; a term has 4 to 253 letters, a
quoted one 3 to 253; fewer letters are not dropped but begin the next term (a
quote with fewer stays open); OR does nothing, so it does not take back an AND
or NOT before it; an operator before the first term works on nothing, one
after the last does nothing. An opening parenthesis ends a term when terms are
collected, but not when the tree is built: a term run into it is then not
among those collected and is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from palimpsest.functions.tokens import BYTES, LOWER

OPERATORS = {"or": "OR", "and": "AND", "not": "NOT"}
MOST = 253
_LETTER = BYTES | dict(zip(LOWER, LOWER))


@dataclass(frozen=True, order=True)
class Term:
    word: str
    exact: bool = False


@dataclass
class Group:
    """Steps (operator, operand) folded over the empty set."""

    steps: list[tuple[str, Term | Group]] = field(default_factory=list)


@dataclass(frozen=True)
class SearchConfig:
    exact_match: bool = False
    min_char: int = 4  # a prefix needs one letter more
    glue_short: bool = True  # short pieces begin the next term


@dataclass
class Query:
    tree: Group
    terms: list[Term]


def well_formed(text: str) -> bool:
    """Wrapped in parentheses that match."""
    if not text or text[0] != "(" or text[-1] != ")":
        return False
    depth = 0
    for char in text:
        depth += (char == "(") - (char == ")")
        if depth < 0:
            return False
    return depth == 0


class _Reader:
    """Yields "(", ")", operators and Terms. `building`: as the tree is built, else as terms are collected."""

    def __init__(self, text: str, config: SearchConfig, building: bool):
        self.text = text.encode("utf-8", "surrogateescape").decode("latin-1")
        self.config, self.building = config, building
        self.held, self.quoted = "", False

    def _end(self) -> Iterator[str | Term]:
        """What a separator makes of the letters held."""
        if self.held in OPERATORS:
            yield OPERATORS[self.held]
            self.held = ""
        elif 3 < len(self.held) <= MOST:
            yield Term(self.held, self.config.exact_match)
            self.held = ""
        elif not self.config.glue_short:
            self.held = ""

    def _quote(self) -> Iterator[str | Term]:
        if not self.quoted:
            self.quoted = True
        elif 2 < len(self.held) <= MOST:
            yield Term(self.held, True)
            self.held, self.quoted = "", False
        elif self.building:
            yield from self._end()

    def __iter__(self) -> Iterator[str | Term]:
        for char in self.text:
            if char == '"':
                yield from self._quote()
            elif char == "(":
                if not self.building:
                    yield from self._end()
                yield char
            elif char in _LETTER:
                self.held += _LETTER[char]
            else:
                yield from self._end()
                if char == ")":
                    yield char
        if not self.building:
            yield from self._end()


def parse(text: str, config: SearchConfig = SearchConfig()) -> Query | None:
    """The query typed as `text`; None where it is malformed and finds nothing."""
    whole = f"({text})"
    if not well_formed(whole):
        return None
    known = {t for t in _Reader(whole, config, building=False) if isinstance(t, Term)}
    top, open_, pending = [], [], []
    for part in _Reader(whole, config, building=True):
        if part == "(":
            open_.append(Group())
            pending.append("OR")
            continue
        if part == ")":
            done = open_.pop()
            pending.pop()
            if not open_:
                top.append(done)
                continue
            part = done
        if not open_:
            continue
        if isinstance(part, str):
            if part != "OR":
                pending[-1] = part
        elif isinstance(part, Group) or part in known:
            open_[-1].steps.append((pending[-1], part))
            pending[-1] = "OR"
    return Query(top[0], sorted(used(top[0])))


def used(group: Group) -> set[Term]:
    out: set[Term] = set()
    for _, operand in group.steps:
        out |= used(operand) if isinstance(operand, Group) else {operand}
    return out
