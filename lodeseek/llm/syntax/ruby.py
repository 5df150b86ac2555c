"""Ruby: statements up to ``end`` by recursive descent, expressions by precedence climbing."""

from __future__ import annotations

import re
from collections.abc import Callable

from lodeseek.llm.syntax.core import (
    CLOSE, END, TokenClasses, Unexpected, conflict_lines, located, match_brackets, operators_regex,
)

_KEYWORDS = set(
    "alias and begin break case class def do else elsif end ensure false for if in module next nil not or redo rescue "
    "retry return self super then true undef unless until when while yield defined?".split()
)
_OPERATORS = (
    "+ - * / % ** == != === =~ !~ <=> < > <= >= && || ! & | ^ ~ << >> = += -= *= /= %= **= ||= &&= |= &= <<= >>= .. ... "
    "? : , ; ( ) [ ] { } -> => :: . &."
)
_LEVELS = [
    "and or", "= += -= *= /= %= **= ||= &&= |= &= <<= >>=", "?", ".. ...", "||", "&&", "<=> == === != =~ !~", "< > <= >=", "| ^", "&",
    "<< >>", "+ -", "* / %", "**",
]
_PRECEDENCE = {op: level for level, ops in enumerate(_LEVELS, 1) for op in ops.split()}
_RIGHT = 2
_INTERPOLATED = r"#\{(?:[^{}\"]|\"[^\"]*\"|\{[^{}]*\})*\}"
_LEX = re.compile(
    r"(?:[ \t\r\f\v﻿]|\\\n|#[^\n]*|(?:(?<=\n)|\A)=begin\b[\s\S]*?\n=end[^\n]*|\n(?=[ \t\r\n]{0,60}&?\.\s*[^\W\d]))*+(?:\Z|("
    r"\n|<<[~-]?(?P<q>['\"]?)(?P<tag>[A-Z_]\w*)(?P=q)[\s\S]*?\n[ \t]*(?P=tag)\b"
    rf"|:?\"(?:[^\"\\#]|\\[\s\S]|{_INTERPOLATED}|#)*\"|:?'(?:[^'\\]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
    r"|%[wWiIqQr]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}|<[^>]*>)(?<!%\()[a-z]*"
    r"|(?:(?<=[(=,\[!&|~{;])|(?<=[(=,\[!&|~{;] )|(?<=\bif )|(?<=when )|(?<=and ))/(?:[^/\\\n]|\\.)+/[a-z]*"
    r"|:[^\W\d]\w*[?!=]?|:(?:\[\]=?|[+\-*/%<>=~!]+)(?=[\s),])"
    r"|defined\?|[^\W\d]\w*[?!]?:(?![:\w])|(?:@@?|\$)?[^\W\d]\w*(?:[?!](?![=~]))?|\$[\W\d]"
    r"|\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d+)?|&?\.\s*[^\W\d]\w*[?!]?|::\s*[^\W\d]\w*[?!]?|" + operators_regex(_OPERATORS) + r"|\S))"
)


class _Classes(TokenClasses):
    def __missing__(self, token: str) -> str:
        if token[0] == ":" and len(token) > 1 and token != "::" and token[1] != ":":
            kind = "s"
        elif token[0] == "%" and len(token) > 2 and token not in self.operators or token[:2] == "<<" and len(token) > 3:
            kind = "s"
        elif token[-1] == ":" and len(token) > 1 and token != "::":
            kind = "label"
        else:
            return super().__missing__(token)
        if len(self) < 500_000:
            self[token] = kind
        return kind


_CLASSES = _Classes(_KEYWORDS, set(_OPERATORS.split()))


def check(text: str) -> list[tuple[int, str]]:
    text = re.split(r"(?m)^__END__$", text)[0]
    tokens = [m[0] for m in _LEX.findall(text)]
    while tokens and not tokens[-1]:  # the end of the text
        tokens.pop()
    kinds, match, places = match_brackets([_CLASSES[t] for t in tokens], True)
    errors = _parse(kinds, match)
    places += [len(tokens)] * 6
    found = located(_LEX, text, [(places[min(at, len(places) - 1)], message) for at, message in errors])
    marks = conflict_lines(text)
    if marks:
        starts = {m.start(1) for m in _LEX.finditer(text)}
        at = 0
        for n, line in enumerate(text.split("\n")):
            if n in marks and at in starts:
                found.append((n, "conflict mark"))
            at += len(line) + 1
    return sorted(found)


def _parse(k: list[str], match: dict[int, int]) -> list[tuple[int, str]]:
    n = len(k)
    k += [END] * 6
    errors: list[tuple[int, str]] = []
    precedence = _PRECEDENCE
    operand = {"i", "n", "s", "label", "self", "nil", "true", "false", "->", "defined?", "::", "not", "super", "yield", "case", "if"}
    ends = {"\n", ";", END, "end", "}", ")", "]"}
    modifiers = {"if", "unless", "while", "until", "rescue"}

    def fail(i: int, wanted: str):
        found = k[i]
        shown = {END: "end of text", "\n": "end of line"}.get(found, repr(found))
        raise Unexpected(i, f"{wanted} expected, {shown} found")

    def expect(i: int, kind: str) -> int:
        if k[i] != kind:
            fail(i, repr(kind))
        return i + 1

    def lines(i: int) -> int:
        while k[i] == "\n" or k[i] == ";":
            i += 1
        return i

    def listed(i: int, close: str, item: Callable[[int], int]) -> int:
        i = lines(i)
        while k[i] != close:
            i = lines(item(i))
            if k[i] == ",":
                i = lines(i + 1)
            elif k[i] != close:
                fail(i, f"',' or {close!r}")
        return i + 1

    def argument(i: int) -> int:
        if k[i] in ("*", "**", "&"):
            i += 1
            if k[i] in (",", ")", "]", "|"):
                return i
        if k[i] == "label":
            return i + 1 if k[i + 1] in (",", ")", "\n") else expr(lines(i + 1), _RIGHT)
        i = expr(i, _RIGHT)
        return expr(lines(i + 1), _RIGHT) if k[i] == "=>" else i

    def arguments(i: int) -> int:
        """Without brackets."""
        i = argument(i)
        while k[i] == ",":
            i = argument(lines(i + 1))
        return i

    def block_parameters(i: int) -> int:
        if k[i] == "||":
            return i + 1
        if k[i] == "|":
            i += 1
            while k[i] != "|":
                i = parameter(i, 10)
                if k[i] in (",", ";"):
                    i += 1
                elif k[i] != "|":
                    fail(i, "',' or '|'")
            return i + 1
        return i

    def parameter(i: int, least: int = _RIGHT) -> int:
        if k[i] in ("*", "**", "&", "..."):
            return i + 1 if k[i + 1] != "i" else i + 2
        if k[i] == "(":
            return listed(i + 1, ")", parameter)
        if k[i] == "label":
            return i + 1 if k[i + 1] in (",", ")", "\n", "|") else expr(i + 1, least)
        i = expect(i, "i")
        return expr(i + 1, least) if k[i] == "=" else i

    def do_block(i: int) -> int:
        return body(block_parameters(i + 1), True)

    def body(i: int, rescues: bool) -> int:
        """Statements and, if allowed, rescue and ensure, up to ``end``."""
        i = statements(i, {"end", "rescue", "else", "ensure"} if rescues else {"end"})
        while k[i] != "end":
            if k[i] == "rescue":
                i += 1
                while k[i] not in ("\n", ";", "then", END):
                    i = expr(i, _RIGHT) if k[i] not in ("=>", ",") else i + 1
                i += k[i] == "then"
            else:
                i += 1
            i = statements(i, {"end", "rescue", "else", "ensure"})
        return i + 1

    def primary(i: int) -> int:
        c = k[i]
        if c in ("i", "n", "self", "nil", "true", "false", "super", "redo", "retry"):
            return i + 1
        if c == "s":
            while k[i] == "s":
                i += 1
            return i
        if c == "(":
            i = lines(i + 1)
            while k[i] != ")":
                i = lines(modified(i))
                if k[i] == END:
                    fail(i, "')'")
            return i + 1
        if c == "[":
            return listed(i + 1, "]", argument)
        if c == "{":
            return listed(i + 1, "}", argument)
        if c == "->":
            i += 1
            if k[i] == "(":
                i = listed(i + 1, ")", parameter)
            elif k[i] == "i":
                i = parameter(i)
                while k[i] == ",":
                    i = parameter(i + 1)
            return brace_block(i) if k[i] == "{" else body(expect(i, "do"), True)
        if c == "::":
            return expect(i + 1, "i")
        if c in COMPOUND:
            return COMPOUND[c](i)
        if c in ("yield", "return", "break", "next", "defined?"):
            i += 1
            return i if k[i] in ends or k[i] in modifiers else arguments(i)
        if c == "..":
            return expr(i + 1, 5)
        if c == ".i" and k[i - 1] in ("(", ",", "=", "\n"):
            return i + 1
        fail(i, "an expression")

    def brace_block(i: int) -> int:
        return statements(block_parameters(expect(i, "{")), {"}"}) + 1

    def unary(i: int) -> int:
        while k[i] in ("-", "!", "+", "~", "&", "*", "**"):
            i += 1
        if k[i] == "not":
            return expr(i + 1, 3)
        i = primary(i)
        while True:
            c = k[i]
            if c == ".i":
                i += 1
            elif c == "(" and k[i - 1] in ("i", ".i", "super", "yield", "defined?", "self", "."):
                i = listed(i + 1, ")", argument)
            elif c == "[" :
                i = listed(i + 1, "]", argument)
            elif c == "{" and k[i - 1] in ("i", ".i", ")", "super"):
                i = brace_block(i)
            elif c == "do" and not no_do[0] and k[i - 1] in ("i", ".i", ")", "]", "super", "s", "n"):
                i = do_block(i)
            else:
                return i

    no_do = [False]

    def expr(i: int, least: int) -> int:
        i = unary(i)
        c = k[i]
        level = precedence.get(c)
        while level is not None and level >= least:
            if c == "?":
                i = expr(lines(i + 1), 3)
                if k[i] == "label":
                    fail(i, "':'")
                i = expr(lines(expect(lines(i), ":")), 3)
            elif level == 2:
                i = lines(i + 1)
                i = command(i)
                while k[i] == "," and multiple(i):
                    i = expr(lines(i + 1), 3)
                if k[i] == "rescue":
                    i = expr(i + 1, 3)
            elif c in ("..", "...") and k[i + 1] in (")", "]", "then", "\n"):
                i += 1
            else:
                i = expr(lines(i + 1), level + (c != "**"))
            c = k[i]
            level = precedence.get(c)
        return i

    def multiple(i: int) -> bool:
        return depth_args[0] == 0

    depth_args = [0]

    def command(i: int) -> int:
        """An expression, or a call whose arguments have no brackets."""
        start = i
        if k[i] in ("i", "self", "s", "n", "::", "super", "yield", "("):
            j = i + 1
            if k[i] == "i" or k[i] == "super":
                while k[j] == ".i" or k[j] == "[" and j in match and k[match[j] + 1] in (".i",):
                    j = j + 1 if k[j] == ".i" else match[j] + 1
                if k[j] in operand and k[j] not in modifiers:
                    j = arguments(j)
                    if k[j] == "do" and not no_do[0]:
                        j = do_block(j)
                        while k[j] == ".i":
                            j = unary_tail(j)
                    return j
        j = expr(start, 1)
        if k[j] in operand and k[j] not in modifiers and k[j - 1] == ".i":
            j = arguments(j)
            if k[j] == "do" and not no_do[0]:
                j = do_block(j)
        return j

    def unary_tail(i: int) -> int:
        i += 1
        if k[i] == "(":
            i = listed(i + 1, ")", argument)
        if k[i] == "{":
            i = brace_block(i)
        return i

    def modified(i: int) -> int:
        """A simple statement with its modifiers."""
        i = command(i)
        if k[i] == ",":  # several targets
            while k[i] == ",":
                i = expr(i + 1 + (k[i + 1] == "*"), 3)
            i = arguments(lines(expect(i, "=")))
        if k[i] in ("=", "+=", "-=", "||="):
            i = command(lines(i + 1))
        while k[i] in modifiers or k[i] in ("and", "or"):
            i = command(lines(i + 1))
        return i

    def header(i: int) -> int:
        before, no_do[0] = no_do[0], True
        try:
            return expr(i + (k[i] == "not"), 1)
        finally:
            no_do[0] = before

    def if_(i: int) -> int:
        i = header(i + 1)
        i += k[i] == "then"
        i = statements(i, {"end", "else", "elsif"})
        while k[i] == "elsif":
            i = header(i + 1)
            i += k[i] == "then"
            i = statements(i, {"end", "else", "elsif"})
        if k[i] == "else":
            i = statements(i + 1, {"end"})
        return i + 1

    def while_(i: int) -> int:
        i = header(i + 1)
        i += k[i] == "do"
        return statements(i, {"end"}) + 1

    def for_(i: int) -> int:
        i = expect(i + 1, "i")
        while k[i] == ",":
            i = expect(i + 1, "i")
        i = header(expect(i, "in"))
        i += k[i] == "do"
        return statements(i, {"end"}) + 1

    def case_(i: int) -> int:
        i += 1
        if k[i] != "\n":
            i = expr(i, 1)
        i = lines(i)
        if k[i] not in ("when", "in"):
            fail(i, "'when'")
        while k[i] in ("when", "in"):
            i = argument(i + 1)
            while k[i] == ",":
                i = argument(lines(i + 1))
            i += k[i] == "then"
            i = statements(i, {"end", "else", "when", "in"})
        if k[i] == "else":
            i = statements(i + 1, {"end"})
        return i + 1

    def def_(i: int) -> int:
        i += 1
        if k[i] in ("self", "i") and k[i + 1] == ".i":
            i += 2
        elif k[i] == "label":
            fail(i, "a name")
        elif k[i] in ("\n", END, "("):
            fail(i, "a name")
        else:
            i += 1
            while k[i] in ("=", "]") and k[i + 1] == "(":
                i += 1
        if k[i] == "(":
            i = listed(i + 1, ")", parameter)
        elif k[i] not in ("\n", ";", "="):
            i = parameter(i)
            while k[i] == ",":
                i = parameter(i + 1)
        if k[i] == "=":
            return command(lines(i + 1))
        if k[i] not in ("\n", ";"):
            fail(i, "the end of the line")
        return body(i, True)

    def class_(i: int) -> int:
        i += 1
        if k[i] == "<<":
            return body(expr(i + 1, 3), False)
        i = expect(i, "i")
        while k[i] == ".i":
            i += 1
        if k[i] == "<":
            i = expr(i + 1, 3)
        if k[i] not in ("\n", ";", "end"):
            fail(i, "the end of the line")
        return body(i, False)

    def begin(i: int) -> int:
        i = body(i + 1, True)
        return i

    COMPOUND = {
        "if": if_, "unless": if_, "while": while_, "until": while_, "for": for_, "case": case_, "def": def_, "class": class_, "module": class_,
        "begin": begin,
    }

    def statement(i: int) -> int:
        c = k[i]
        if c in COMPOUND:
            i = COMPOUND[c](i)
            if k[i] in (".i", "+", "||", "&&"):
                i = unary_tail(i) if k[i] == ".i" else expr(i + 1, 3)
            while k[i] in modifiers:
                i = expr(i + 1, 1)
        elif c == "alias" or c == "undef":
            i += 2 + (c == "alias")
        elif c == "*":
            i = modified(i + 1)
        else:
            i = modified(i)
        if k[i] not in ends:
            fail(i, "the end of a statement")
        return i

    def recover(i: int) -> int:
        while k[i] not in ("\n", END):
            i += 1
        return i

    def statements(i: int, stop: set[str]) -> int:
        """Up to one of ``stop``, which isn't consumed."""
        before, no_do[0] = no_do[0], False
        while True:
            i = lines(i)
            c = k[i]
            if c in stop:
                no_do[0] = before
                return i
            if c == END or c in CLOSE or c == "end":
                fail(i, " or ".join(map(repr, sorted(stop))))
            i = guarded(i)

    def guarded(i: int) -> int:
        try:
            return statement(i)
        except Unexpected as e:
            if e.at >= n:
                raise
            errors.append((e.at, e.message))
            no_do[0] = False
            j = recover(max(i, e.at))
            return j if j > i else i + 1

    i = 0
    while True:
        try:
            i = lines(i)
            if k[i] == END:
                return errors
            if k[i] in ("end", "else", "elsif", "when", "rescue", "ensure") or k[i] in CLOSE:
                fail(i, "a statement")
            i = guarded(i)
        except Unexpected as e:
            errors.append((e.at, e.message))
            if e.at >= n:
                return errors
            i = recover(max(i, e.at))
