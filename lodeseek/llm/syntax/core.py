"""What the grammars share: token classes, errors, recovery."""

from __future__ import annotations

import re
from bisect import bisect_left


class Unexpected(Exception):
    """Parsing can't go on at token ``at``."""

    def __init__(self, at: int, message: str):
        self.at = at
        self.message = message


OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {")", "]", "}"}
END = "\0"

_CONFLICT = re.compile(r"(?:<{7}|>{7}|\|{7})(?: |$)|={7}$")


class TokenClasses(dict):
    """Token text to class: keywords and operators stand for themselves, "i" name, "n" number, "s" string, ".i" member."""

    def __init__(self, keywords: set[str], operators: set[str]):
        super().__init__()
        self.keywords, self.operators = keywords, operators

    def __missing__(self, token: str) -> str:
        first = token[0]
        if token in self.keywords or token in self.operators:
            kind = token
        elif first == "\n":
            kind = "\n"
        elif first.isdigit():
            kind = "n"
        elif first == "'" and len(token) > 1 and token[-1] != "'":
            kind = "i"
        elif first in "\"'`/" and len(token) > 1 or token[-1] in "\"'" and len(token) > 2:
            kind = "s"
        elif first in ".?:" and len(token) > 1:
            kind = ".i"
        elif first.isalpha() or first in "_$@#" and len(token) > 1 or first == "_":
            kind = "i"
        else:
            kind = "bad " + first
        if len(self) < 500_000:
            self[token] = kind
        return kind


def operators_regex(operators: str) -> str:
    return "|".join(map(re.escape, sorted(operators.split(), key=len, reverse=True)))


def match_brackets(kinds: list[str], keep_lines: bool) -> tuple[list[str], dict[int, int], list[int]]:
    """Tokens without the line ends that don't count, the partner of each opening bracket, the tokens' old places.

    Line ends within round and square brackets are dropped, repeated ones are merged.
    """
    out: list[str] = []
    places: list[int] = []
    match: dict[int, int] = {}
    stack: list[int] = []
    for place, kind in enumerate(kinds):
        if kind == "\n":
            if not keep_lines or stack and out[stack[-1]] != "{" or out and out[-1] == "\n":
                continue
        elif kind in OPEN:
            stack.append(len(out))
        elif kind in CLOSE and stack:
            if OPEN[out[stack[-1]]] == kind:
                match[stack.pop()] = len(out)
            elif len(stack) > 1 and OPEN[out[stack[-2]]] == kind:  # one bracket was left open
                stack.pop()
                match[stack.pop()] = len(out)
        out.append(kind)
        places.append(place)
    return out, match, places


def conflict_lines(text: str) -> list[int]:
    """Lines that look like the marks of an unfinished merge (whether they lie in comments or strings isn't known here)."""
    if "<<<<<<<" not in text and ">>>>>>>" not in text and "=======" not in text and "|||||||" not in text:
        return []
    return [n for n, line in enumerate(text.split("\n")) if _CONFLICT.match(line.rstrip("\r"))]


def token_lines(lexer: re.Pattern, text: str, wanted: list[int]) -> list[int]:
    """Lines (0-based) of the tokens with these ordinals; one behind the last token is the last line."""
    starts = [m.start(1) for m in lexer.finditer(text) if m.group(1)]
    ends = [m.start() for m in re.finditer("\n", text)]
    return [bisect_left(ends, starts[at]) if at < len(starts) else len(ends) for at in wanted]


def located(lexer: re.Pattern, text: str, errors: list[tuple[int, str]]) -> list[tuple[int, str]]:
    if not errors:
        return []
    lines = token_lines(lexer, text, [at for at, _ in errors])
    return [(line, message) for line, (_, message) in zip(lines, errors)]
