"""Parsing-expression grammars with memoised rules (packrat parsing)."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A parser takes the state and an offset and returns (end, value), or None if it doesn't match there.
Parser = Callable[["State", int], "tuple[int, object] | None"]


class State:
    """A text under parsing, with the results of rules by (rule, offset)."""

    __slots__ = ("memo", "text")

    def __init__(self, text: str):
        self.text = text
        self.memo: dict[tuple[int, int], tuple[int, object] | None] = {}


def token(pattern: str, flags: int = 0) -> Parser:
    """A regular expression; its value is the match."""
    match = re.compile(pattern, flags).match

    def parse(s: State, at: int):
        m = match(s.text, at)
        return None if m is None else (m.end(), m)

    return parse


def between(left: str, right: str) -> Parser:
    """From one mark to the next other one; its value is a tuple with the text."""

    def parse(s: State, at: int):
        if not s.text.startswith(left, at):
            return None
        end = s.text.find(right, at + len(left))
        return None if end < 0 else (end + len(right), (s.text[at : end + len(right)],))

    return parse


def seq(*parts: Parser) -> Parser:
    parts = tuple(map(_plain, parts))

    def parse(s: State, at: int):
        values = []
        for part in parts:
            got = part(s, at)
            if got is None:
                return None
            at = got[0]
            values.append(got[1])
        return at, values

    return parse


def choice(*parts: Parser) -> Parser:
    parts = tuple(map(_plain, parts))

    def parse(s: State, at: int):
        for part in parts:
            got = part(s, at)
            if got is not None:
                return got
        return None

    return parse


def many(part: Parser, least: int = 0) -> Parser:
    part = _plain(part)

    def parse(s: State, at: int):
        values = []
        while True:
            got = part(s, at)
            if got is None or got[0] == at:
                break
            at = got[0]
            values.append(got[1])
        return None if len(values) < least else (at, values)

    return parse


def optional(part: Parser) -> Parser:
    part = _plain(part)
    return lambda s, at: part(s, at) or (at, None)


def unless(part: Parser) -> Parser:
    """Matches nothing, where ``part`` doesn't match."""
    part = _plain(part)
    return lambda s, at: None if part(s, at) is not None else (at, None)


def action(part: Parser, act: Callable[[object, int, int], object]) -> Parser:
    """The value becomes ``act(value, start, end)``."""
    part = _plain(part)

    def parse(s: State, at: int):
        got = part(s, at)
        return None if got is None else (got[0], act(got[1], at, got[0]))

    return parse


def skip(part: Parser) -> Parser:
    """The value is dropped: for stretches of text that no action asks for."""
    part = _plain(part)

    def parse(s: State, at: int):
        got = part(s, at)
        return None if got is None else (got[0], None)

    return parse


class Rule:
    """A named rule: may be used before it is defined, and is memoised."""

    def __init__(self):
        self.part: Parser | None = None

    def parse(self, s: State, at: int):
        key = (id(self), at)
        memo = s.memo
        if key not in memo:
            memo[key] = None  # a rule that calls itself at the same place doesn't match
            memo[key] = self.part(s, at)
        return memo[key]

    def define(self, part: Parser) -> None:
        self.part = _plain(part)


def _plain(part: Parser | Rule) -> Parser:
    """A rule's method: a call of it, unlike one of the object, takes no room on the C stack."""
    return part.parse if isinstance(part, Rule) else part
