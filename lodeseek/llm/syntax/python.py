"""Python: statements and suites by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

import re
from collections.abc import Callable

from lodeseek.llm.syntax.core import (
    CLOSE, END, OPEN, TokenClasses, Unexpected, conflict_lines, located, operators_regex,
)

_KEYWORDS = set(
    "and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield".split()
)
_OPERATORS = (
    "+ - * / // % ** @ << >> & | ^ ~ < > <= >= == != = += -= *= /= //= %= **= @= <<= >>= &= |= ^= := -> ... ( ) [ ] { } , : ; ."
)
_ASSIGN = set("= += -= *= /= //= %= **= @= <<= >>= &= |= ^=".split())
_LEVELS = ["or", "and", "", "in is < > <= >= == != not", "|", "^", "&", "<< >>", "+ -", "* / // % @", "", "**"]
_PRECEDENCE = {op: level for level, ops in enumerate(_LEVELS, 1) for op in ops.split()}
_NOT, _UNARY = 3, 11

_LEX = re.compile(
    r"(?:[ \t\f\r﻿]|\\\r?\n|#[^\n]*)*+(?:\Z|("
    r"\n(?:[ \t\f\r]*(?:#[^\n]*)?\n)*[ \t\f]*"
    r'|[A-Za-z]{0,2}"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|[A-Za-z]{0,2}\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\''
    r'|[A-Za-z]{0,2}"(?:[^"\\\n]|\\[\s\S])*"|[A-Za-z]{0,2}\'(?:[^\'\\\n]|\\[\s\S])*\''
    r"|[^\W\d]\w*|\d\w*(?:\.\w*)?(?:(?<=[eE])[+-]\d+)?|\.\d\w*|\.\s*[^\W\d]\w*|" + operators_regex(_OPERATORS) + r"|\S))"
)
_CLASSES = TokenClasses(_KEYWORDS, set(_OPERATORS.split()))
IN, OUT = "indent", "dedent"


def _layout(tokens: list[str]) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """Token classes with "\\n", "indent" and "dedent", the tokens' old places, and errors of indentation."""
    kinds: list[str] = []
    places: list[int] = []
    errors: list[tuple[int, str]] = []
    depth = 0
    levels = [0]
    classes = _CLASSES
    for place, token in enumerate(tokens):
        if token[0] == "\n":
            if depth or not kinds:
                if not depth and not kinds and place + 1 < len(tokens) and not token.endswith("\n"):
                    errors.append((place, "unexpected indentation"))
                continue
            width = len(token[token.rfind("\n") + 1 :].expandtabs())
            if place + 1 == len(tokens):
                width = 0
            if kinds[-1] != "\n":
                kinds.append("\n")
                places.append(place)
            if width > levels[-1]:
                levels.append(width)
                kinds.append(IN)
                places.append(place)
            else:
                while width < levels[-1]:
                    levels.pop()
                    kinds.append(OUT)
                    places.append(place)
                if width != levels[-1]:
                    errors.append((place, "indentation matches no outer level"))
                    levels.append(width)
            continue
        kind = classes[token]
        if kind in OPEN:
            depth += 1
        elif kind in CLOSE and depth:
            depth -= 1
        kinds.append(kind)
        places.append(place)
    if kinds and kinds[-1] not in ("\n", OUT):
        kinds.append("\n")
        places.append(len(tokens))
    kinds += [OUT] * (len(levels) - 1)
    places += [len(tokens)] * (len(levels) - 1)
    return kinds, places, errors


def check(text: str) -> list[tuple[int, str]]:
    tokens = _LEX.findall(text)
    while tokens and not tokens[-1]:  # the end of the text
        tokens.pop()
    kinds, places, errors = _layout(tokens)
    if text[:1] in (" ", "\t") and tokens and tokens[0][0] != "\n":
        errors.append((0, "unexpected indentation"))
    if re.search(r"\n[ \t]+#[^\n]*\s*\Z", text) and tokens and tokens[-1][0] == "\n":
        errors.append((len(tokens), "the text stops in a comment within a block"))
    places += [len(tokens)] * 6
    errors += [(places[min(at, len(places) - 1)], message) for at, message in _parse(kinds)]
    found = located(_LEX, text, errors)
    marks = conflict_lines(text)
    if marks:
        starts, at = {}, 0
        for n, line in enumerate(text.split("\n")):
            starts[at] = n
            at += len(line) + 1
        wanted = set(marks)
        ends = {m.end(1) for m in _LEX.finditer(text) if (m.group(1) or " ")[0] == "\n"} | {0}
        found += [(n, "conflict mark") for s, n in starts.items() if n in wanted and s in ends]
    return sorted(found)


def _parse(k: list[str]) -> list[tuple[int, str]]:
    n = len(k)
    k += [END] * 6
    errors: list[tuple[int, str]] = []
    precedence = _PRECEDENCE
    stops = {"\n", ")", "]", "}", ",", ":", "=", ";", END, "for", "if", "else"} | _ASSIGN
    plain = stops | {op for op in precedence if op != "not"}

    def fail(i: int, wanted: str):
        found = k[i]
        shown = {END: "end of text", "\n": "end of line"}.get(found, repr(found))
        raise Unexpected(i, f"{wanted} expected, {shown} found")

    def expect(i: int, kind: str) -> int:
        if k[i] != kind:
            fail(i, repr(kind))
        return i + 1

    def listed(i: int, close: str, item: Callable[[int], int]) -> int:
        while k[i] != close:
            i = item(i)
            if k[i] == ",":
                i += 1
            elif k[i] != close:
                fail(i, f"',' or {close!r}")
        return i + 1

    def argument(i: int) -> int:
        if k[i] in ("*", "**"):
            return expr(i + 1)
        i = expr(i)
        if k[i] == "=":
            return expr(i + 1)
        return comprehension(i)

    def comprehension(i: int) -> int:
        while k[i] in ("for", "async"):
            i += k[i] == "async"
            i = expect(targets(i + 1), "in")
            i = binary(i, 1)
            while k[i] == "if":
                i = binary(i + 1, 1)
                if k[i] == ":=":
                    i = expr(i + 1)
        return i

    def targets(i: int) -> int:
        while True:
            i = binary(i + (k[i] == "*"), 5)
            if k[i] != ",":
                return i
            i += 1
            if k[i] in ("in", "=", "\n"):
                return i

    def subscript(i: int) -> int:
        if k[i] == "*":
            i += 1
        if k[i] != ":":
            i = expr(i)
        while k[i] == ":":
            i += 1
            if k[i] not in (":", "]", ","):
                i = expr(i)
        return i

    def entry(i: int) -> int:
        if k[i] in ("**", "*"):
            return binary(i + 1, 5)
        i = expr(i)
        if k[i] == ":":
            i = expr(i + 1)
        return comprehension(i)

    def starred(i: int) -> int:
        return comprehension(binary(i + 1, 5) if k[i] == "*" else expr(i))

    def unary(i: int) -> int:
        c = k[i]
        if c == "i" or c == "n" or c == "...":
            i += 1
        elif c == "s":
            while k[i] == "s":
                i += 1
        elif c == "(":
            i = listed(i + 1, ")", lambda j: expr(j) if k[j] == "yield" else starred(j))
        elif c == "[":
            i = listed(i + 1, "]", starred)
        elif c == "{":
            i = listed(i + 1, "}", entry)
        elif c in ("-", "+", "~"):
            return binary(i + 1, _UNARY)
        elif c == "not":
            return binary(i + 1, _NOT)
        elif c == "await":
            return unary(i + 1)
        elif c == "lambda":
            return expr(expect(parameters(i + 1, ":"), ":"))
        elif c == "yield":
            i += 1
            if k[i] == "from":
                return expr(i + 1)
            return i if k[i] in ("\n", ")", "=") else expressions(i)
        else:
            fail(i, "an expression")
        while True:
            c = k[i]
            if c == ".i":
                i += 1
            elif c == "(":
                i += 1
                if k[i] == ")":
                    i += 1
                else:
                    i = listed(i, ")", argument)
            elif c == "[":
                if k[i + 1] == "]":
                    fail(i + 1, "an expression")
                i = listed(i + 1, "]", subscript)
            else:
                return i

    def binary(i: int, least: int) -> int:
        c = k[i]
        if (c == "i" or c == "n") and k[i + 1] in plain:
            i += 1
        else:
            i = unary(i)
        c = k[i]
        level = precedence.get(c)
        while level is not None and level >= least:
            if c == "not":
                i = expect(i + 1, "in")
            else:
                i += 1
                if c == "is" and k[i] == "not":
                    i += 1
            i = binary(i, level + 1 if c != "**" else _UNARY)
            c = k[i]
            level = precedence.get(c)
        return i

    def expr(i: int) -> int:
        i = binary(i, 1)
        if k[i] == "if":
            i = expr(expect(binary(i + 1, 1), "else"))
        elif k[i] == ":=":
            i = expr(i + 1)
        return i

    def expressions(i: int) -> int:
        while True:
            i = binary(i + 1, 5) if k[i] == "*" else expr(i)
            if k[i] != ",":
                return i
            i += 1
            if k[i] in ("\n", "=", ")", ":", ";", "]"):
                return i

    def parameters(i: int, close: str) -> int:
        while k[i] != close:
            if k[i] in ("*", "**", "/"):
                i += 1
                if k[i] in (",", close):
                    i += k[i] == ","
                    continue
            i = expect(i, "i")
            if k[i] == ":" and close == ")":
                i = expr(i + 1 + (k[i + 1] == "*"))
            if k[i] == "=":
                i = expr(i + 1)
            if k[i] == ",":
                i += 1
            elif k[i] != close:
                fail(i, f"',' or {close!r}")
        return i

    def suite(i: int) -> int:
        i = expect(i, ":")
        if k[i] != "\n":
            return simple_line(i)
        i += 1
        if k[i] != IN:
            fail(i, "an indented block")
        i += 1
        while k[i] != OUT:
            if k[i] == END:
                return i
            i = guarded(i)
        return i + 1

    def name_path(i: int) -> int:
        i = expect(i, "i")
        while k[i] == ".i":
            i += 1
        return i

    def simple_line(i: int) -> int:
        while True:
            i = simple(i)
            if k[i] == ";":
                i += 1
                if k[i] != "\n":
                    continue
            return expect(i, "\n")

    def simple(i: int) -> int:
        c = k[i]
        if c in ("pass", "break", "continue"):
            return i + 1
        if c == "return":
            return i + 1 if k[i + 1] in ("\n", ";") else expressions(i + 1)
        if c == "raise":
            if k[i + 1] in ("\n", ";"):
                return i + 1
            i = expr(i + 1)
            return expr(i + 1) if k[i] == "from" else i
        if c == "import":
            i = name_path(i + 1)
            while True:
                if k[i] == "as":
                    i = expect(i + 1, "i")
                if k[i] != ",":
                    return i
                i = name_path(i + 1)
        if c == "from":
            i += 1
            while k[i] in (".", "..."):
                i += 1
            i = i + 1 if k[i] == ".i" else i if k[i] == "import" else name_path(i)
            while k[i] == ".i":
                i += 1
            i = expect(i, "import")
            if k[i] == "*":
                return i + 1
            if k[i] == "(":
                return listed(i + 1, ")", imported)
            i = imported(i)
            while k[i] == ",":
                i = imported(i + 1)
            return i
        if c in ("global", "nonlocal"):
            i = expect(i + 1, "i")
            while k[i] == ",":
                i = expect(i + 1, "i")
            return i
        if c == "del":
            return expressions(i + 1)
        if c == "assert":
            i = expr(i + 1)
            return expr(i + 1) if k[i] == "," else i
        if c == "i" and k[i + 1] == "i" and k[i + 2] in ("=", "["):  # type X = ...
            i = i + 2
            if k[i] == "[":
                i = listed(i + 1, "]", argument)
            return expr(expect(i, "="))
        i = expressions(i)
        if k[i] == ":":
            i = expr(i + 1)
        while k[i] in _ASSIGN:
            i = expr(i + 1) if k[i + 1] == "yield" else expressions(i + 1)
        return i

    def imported(i: int) -> int:
        i = expect(i, "i")
        return expect(i + 1, "i") if k[i] == "as" else i

    def statement(i: int) -> int:
        c = k[i]
        if c == "async":
            i += 1
            c = k[i]
            if c not in ("def", "for", "with"):
                fail(i, "'def', 'for' or 'with'")
        if c == "def":
            i = expect(i + 1, "i")
            if k[i] == "[":
                i = listed(i + 1, "]", argument)
            i = expect(parameters(expect(i, "("), ")"), ")")
            if k[i] == "->":
                i = expr(i + 1)
            return suite(i)
        if c == "class":
            i = expect(i + 1, "i")
            if k[i] == "[":
                i = listed(i + 1, "]", argument)
            if k[i] == "(":
                i = listed(i + 1, ")", argument)
            return suite(i)
        if c == "@":
            i = expect(expr(i + 1), "\n")
            if k[i] not in ("@", "def", "class", "async"):
                fail(i, "a definition")
            return statement(i)
        if c == "if" or c == "while":
            i = suite(expr(i + 1))
            while k[i] == "elif" and c == "if":
                i = suite(expr(i + 1))
            return suite(i + 1) if k[i] == "else" else i
        if c == "for":
            i = suite(expressions(expect(targets(i + 1), "in")))
            return suite(i + 1) if k[i] == "else" else i
        if c == "try":
            i = suite(i + 1)
            handled = k[i] in ("except", "finally")
            while k[i] == "except":
                i += 1 + (k[i + 1] == "*")
                if k[i] != ":":
                    i = expressions(i)
                    if k[i] == "as":
                        i = expect(i + 1, "i")
                i = suite(i)
            if k[i] == "else":
                i = suite(i + 1)
            if k[i] == "finally":
                i = suite(i + 1)
            if not handled:
                fail(i, "'except' or 'finally'")
            return i
        if c == "with":
            i += 1
            grouped = k[i] == "("
            try:
                return suite(with_items(i))
            except Unexpected:
                if not grouped:
                    raise
                return suite(expect(with_items(i + 1), ")"))
        if c == "i" and k[i + 1] in ("i", "n", "s", "(", "[", "{", "-", "*"):  # match and case are soft keywords
            try:
                j = expressions(i + 1)
                if k[j] == "if":
                    j = expr(j + 1)
                if k[j] == ":" and k[j + 1] == "\n" and k[j + 2] == IN:
                    return suite(j)
            except Unexpected:
                pass
        return simple_line(i)

    def with_items(i: int) -> int:
        while True:
            i = expr(i)
            if k[i] == "as":
                i = binary(i + 1, 5)
            if k[i] != ",":
                return i
            i += 1
            if k[i] == ")":
                return i

    def recover(i: int) -> int:
        """Panic mode: to the next line, over the block that belongs to the broken one."""
        while k[i] not in ("\n", END):
            i += 1
        i += k[i] == "\n"
        if k[i] == IN:
            depth = 0
            while k[i] != END:
                depth += (k[i] == IN) - (k[i] == OUT)
                i += 1
                if not depth:
                    break
        return i

    def guarded(i: int) -> int:
        try:
            return statement(i)
        except Unexpected as e:
            errors.append((e.at, e.message))
            return recover(max(i, e.at)) if k[e.at] != OUT and k[e.at] != IN else max(e.at, i) + (k[e.at] == IN or e.at == i)

    i = 0
    while k[i] != END:
        try:
            i = guarded(i) if k[i] not in (OUT, "\n") else i + 1
        except Unexpected as e:
            errors.append((e.at, e.message))
            break
    return errors
