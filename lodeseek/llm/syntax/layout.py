"""Haskell and F#: blocks are told by columns, expressions parsed by precedence climbing.

A block begins at the column of its first token. A line that begins at this column begins the next item, a line that
begins left of it ends the block, and one right of it goes on with the item.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from lodeseek.llm.syntax.core import CLOSE, END, OPEN, TokenClasses, Unexpected, conflict_lines, operators_regex

_STRING = r'"(?:[^"\\]|\\[\s\S])*"'
_CHAR = r"'(?:[^'\\\n]|\\[^'\n]+|\\')'"
_NAME = r"[^\W\d][\w']*"

_HASKELL = set(
    "case class data default deriving do else if import in infix infixl infixr instance let module newtype of then type where forall".split()
)
_HASKELL_MARKS = "= -> <- :: | \\ @ ~ => .. ( ) [ ] { } , ; ` ="
_HASKELL_LEX = re.compile(
    r"(?:[ \t\r\f]|--+(?![!#$%&*+./<=>?@\\^|~:])[^\n]*|\{-[\s\S]*?-\})*+(?:\Z|("
    rf"\n|{_STRING}|{_CHAR}|(?:[A-Z][\w']*\.)+(?:{_NAME}|(?=[^\w\s]))|{_NAME}|\d[\w.]*\d\w*|\d\w*|`[\w'.]+`"
    r"|[!#$%&*+./<=>?@\\^|~:\-]+|[()\[\]{},;]|\S))"
)
_FSHARP = set(
    "abstract and as assert begin class default delegate do done downcast downto elif else end exception extern false "
    "finally for fun function if in inherit inline interface internal lazy let match member module mutable namespace "
    "new null of open or override private public rec return static struct then to true try type upcast use val "
    "when while with yield not".split()
)
_FSHARP_OPS = (
    "+ - * / % ** = <> < > <= >= && || |> >> << <| ||> :: @ ^ |>> >>= <- := -> : :> :?> :? .. .. ; , ( ) [ ] { } [| |] | ? ! & ~ <@ @> # ' _ .["
)
_FSHARP_LEX = re.compile(
    # The reference reads /** as a doc mark here, so /* counts as a comment too.
    r"(?:[ \t\r\f]|//[^\n]*|\(\*(?!\))[\s\S]*?\*\)|/\*[\s\S]*?\*/|^#[^\n]*)*+(?:\Z|("
    rf'\n|"""[\s\S]*?"""|\$?@?{_STRING}|{_CHAR}|\'{_NAME}(?!\')|``[^`\n]+``|{_NAME}!?|\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d+)?|\.\s*{_NAME}|\[<[\s\S]*?>\]|'
    + operators_regex(_FSHARP_OPS) + r"|[!%&*+./<=>?@^|~\-]+|\S))",
    re.MULTILINE,
)


class _Haskell(TokenClasses):
    def __missing__(self, token: str) -> str:
        if token[0] in "!#$%&*+./<=>?@\\^|~:-" and token not in self.operators and token not in ("\\",):
            kind = "op"
        elif token[0] == "`" and len(token) > 2:
            kind = "op"
        elif token[0].isalpha() and token[-1] == "." and token not in self.keywords:
            kind = "i"
        elif token[0] == "'" or token[0] == '"':
            kind = "s" if len(token) > 2 else "bad " + token[0]
        elif (token[0].isalpha() or token[0] == "_") and token not in self.keywords:
            kind = "i"
        else:
            return super().__missing__(token)
        if len(self) < 500_000:
            self[token] = kind
        return kind


class _Fsharp(TokenClasses):
    def __missing__(self, token: str) -> str:
        if token[:2] == "[<":
            kind = "attribute"
        elif token[0] == "'" and token[-1] != "'" and len(token) > 1 or token[:2] == "``":
            kind = "i"
        elif token[-1] == "!" and token[0].isalpha():
            kind = token[:-1] if token[:-1] in self.keywords else "i"
        elif (token[0].isalpha() or token[0] == "_" and len(token) > 1) and token not in self.keywords and token[-1] not in "\"'" :
            kind = "i"
        elif token[0].isalpha() and token[-1] == "'":
            kind = "i"
        elif token[0] in "$@" and token[-1] == '"':
            kind = "s"
        elif token[0] in "!%&*+./<=>?@^|~-" and token not in self.operators and not (token[0] == "." and len(token) > 1 and (token[1].isalpha() or token[1] in "_ \n")):
            kind = "op"
        else:
            return super().__missing__(token)
        if len(self) < 500_000:
            self[token] = kind
        return kind


_HASKELL_CLASSES = _Haskell(_HASKELL, set(_HASKELL_MARKS.split()))
_FSHARP_CLASSES = _Fsharp(_FSHARP, set(_FSHARP_OPS.split()))


class _Tokens:
    """Classes of the tokens without line ends, with lines, columns, and whether a token begins its line."""

    def __init__(self, lex: re.Pattern, classes: TokenClasses, text: str):
        self.kinds: list[str] = []
        self.column: list[int] = []
        self.first: list[bool] = []
        self.line: list[int] = []
        line, column, fresh, at = 0, 0, True, 0
        for m in lex.finditer(text):
            token, start = m.group(1), m.start(1)
            if not token:  # the end of the text
                break
            skipped = text.count("\n", at, start)
            if skipped:
                line += skipped
                at, column = text.rfind("\n", at, start) + 1, 0
                fresh = True
            between = text[at:start]
            if "\t" in between:
                for char in between:
                    column = column + 1 if char != "\t" else (column // 8 + 1) * 8
            else:
                column += len(between)
            at = start
            if token == "\n":
                fresh = True
                continue
            self.kinds.append(classes[token])
            self.column.append(column)
            self.first.append(fresh)
            self.line.append(line)
            fresh = False
        self.kinds += [END] * 6
        self.column += [-1] * 6
        self.first += [True] * 6
        self.line += [text.count("\n")] * 6


def _conflicts(tokens: _Tokens, text: str) -> list[tuple[int, str]]:
    marks = conflict_lines(text)
    begins = {tokens.line[i] for i in range(len(tokens.kinds) - 6) if tokens.first[i] and tokens.column[i] == 0}
    return [(n, "conflict mark") for n in marks if n in begins]


class _Offside:
    """The parts of a layout parser that both languages share."""

    def __init__(self, tokens: _Tokens):
        self.k, self.column, self.first = tokens.kinds, tokens.column, tokens.first
        self.errors: list[tuple[int, str]] = []
        self.limit = [-1]

    def fail(self, i: int, wanted: str):
        found = self.k[i]
        raise Unexpected(i, f"{wanted} expected, {'end of text' if found == END else repr(found)} found")

    def stopped(self, i: int) -> bool:
        """Whether the item ends before token i."""
        return self.first[i] and self.column[i] <= self.limit[-1]

    def kind(self, i: int) -> str:
        return "end of item" if self.stopped(i) else self.k[i]

    def expect(self, i: int, kind: str) -> int:
        if self.kind(i) != kind:
            self.fail(i, repr(kind))
        return i + 1

    def block(self, i: int, item: Callable[[int], int], least: int = -1) -> int:
        """Items that begin at the column of the first; it must lie right of the block around."""
        if self.k[i] == END or self.first[i] and self.column[i] <= max(self.limit[-1], least):
            self.fail(i, "a block")
        column = self.column[i]
        self.limit.append(column)
        depth = len(self.limit)
        try:
            while True:
                try:
                    self.limit[-1] = column
                    i = self.item(i, item)
                except Unexpected as e:
                    del self.limit[depth:]
                    if self.k[e.at] == END:
                        raise
                    self.errors.append((e.at, e.message))
                    i = max(e.at, i + 1)
                    while not (self.first[i] and self.column[i] <= column):
                        i += 1
                while self.k[i] == ";":
                    i += 1
                if not (self.first[i] and self.column[i] == column) and self.k[i - 1] != ";":
                    return i
                if self.k[i] == END:
                    return i
        finally:
            del self.limit[depth - 1 :]

    def item(self, i: int, item: Callable[[int], int]) -> int:
        """One item whose first token, though at the limit, belongs to it."""
        was, self.first[i] = self.first[i], False
        try:
            return item(i)
        finally:
            self.first[i] = was

    def bracketed(self, i: int, one: Callable[[int], int], close: str, separators: tuple[str, ...] = (",",)) -> int:
        """Behind an opening bracket: items up to the closing one; columns left of the block don't end them."""
        self.limit.append(-1)
        depth = len(self.limit)
        try:
            while self.k[i] != close:
                i = one(i)
                if self.k[i] in separators:
                    i += 1
                elif self.k[i] != close:
                    self.fail(i, f"{separators[0]!r} or {close!r}")
            return i + 1
        finally:
            del self.limit[depth - 1 :]

    def run(self, top: Callable[[int], int]) -> list[tuple[int, str]]:
        if self.k[0] == END:
            return []
        i = 0
        if self.column[0] > 0:
            self.errors.append((0, "the text begins within a block"))
        while self.k[i] != END:
            try:
                i = self.block(i, top)
                if self.k[i] != END:
                    self.fail(i, "a declaration")
            except Unexpected as e:
                self.errors.append((e.at, e.message))
                self.limit = [-1]
                if self.k[e.at] == END:
                    break
                i = max(i, e.at)
                while not (self.first[i] and self.column[i] <= 0 and i > e.at):
                    i += 1
        return self.errors


def check_haskell(text: str) -> list[tuple[int, str]]:
    tokens = _Tokens(_HASKELL_LEX, _HASKELL_CLASSES, text)
    p = _Offside(tokens)
    k, fail, expect, kind = p.k, p.fail, p.expect, p.kind
    atoms = {"i", "n", "s", "(", "[", "_"}

    def atom(i: int) -> int:
        c = kind(i)
        if c in ("i", "n", "s"):
            i += 1
        elif c == "(":
            i = p.bracketed(i + 1, in_parens, ")")
        elif c == "[":
            i = p.bracketed(i + 1, in_list, "]", (",", "|", "..") )
        else:
            fail(i, "an expression")
        while kind(i) == "{":
            i = p.bracketed(i + 1, field, "}")
        if kind(i) == "@":
            i = atom(i + 1)
        return i

    def in_parens(i: int) -> int:
        if k[i] in (",", ")"):
            return i
        if k[i] in ("op", "->", "~") and k[i + 1] == ")":
            return i + 1
        if k[i] == "op" and k[i] != "-":
            i = expr(i + 1)
        else:
            i = expr(i)
        if k[i] == "->":
            i = type_(i + 1)
        if k[i] == "op" and k[i + 1] == ")":
            i += 1
        return i

    def in_list(i: int) -> int:
        if k[i] == "]":
            return i
        if k[i] == "let":
            return p.block(i + 1, declaration)
        i = expr(i)
        return expr(i + 1) if k[i] == "<-" else i

    def field(i: int) -> int:
        if k[i] == "..":
            return i + 1
        i = expect(i, "i")
        return expr(i + 1) if k[i] in ("=",) else type_(i + 1) if k[i] == "::" else i

    def expr(i: int) -> int:
        i = operand(i)
        while kind(i) == "op":
            if k[i + 1] in (")",):
                return i
            i = operand(i + 1)
        if kind(i) == "::":
            i = type_(i + 1)
        return i

    def operand(i: int) -> int:
        c = kind(i)
        if c == "op":  # negation, strictness
            i += 1
            c = kind(i)
        if c == "\\":
            i += 1
            if kind(i) == "case":
                return p.block(i + 1, alternative)
            while kind(i) != "->":
                i = atom(i + (kind(i) in ("op", "~")))
            return expr(i + 1)
        if c == "let":
            i = p.block(i + 1, declaration)
            if k[i] == "in":
                return expr_inside(i + 1)
            fail(i, "'in'")
        if c == "if":
            if kind(i + 1) == "|":
                return guards(i + 1, "->")
            i = expr(i + 1)
            i += k[i] == ";"
            i = then(i, "then")
            i += k[i] == ";"
            return then(i, "else")
        if c == "case":
            i = expr(i + 1)
            return p.block(expect(i, "of"), alternative)
        if c == "do":
            return p.block(i + 1, do_item)
        i = atom(i + (c == "~"))
        while kind(i) in atoms or kind(i) in ("~",):
            i = atom(i + (k[i] == "~"))
        if kind(i) in ("\\", "do", "case", "let", "if"):  # the last argument
            return operand(i)
        return i

    def expr_inside(i: int) -> int:
        if k[i] == END or p.stopped(i) and p.limit[-1] >= 0 and p.column[i] <= p.limit[-1]:
            fail(i, "an expression")
        return expr(i)

    def then(i: int, word: str) -> int:
        if k[i] != word or p.first[i] and p.column[i] < p.limit[-1]:
            fail(i, repr(word))
        return expr(i + 1)

    def do_item(i: int) -> int:
        if k[i] == "let":
            i = p.block(i + 1, declaration)
            return expr(i + 1) if kind(i) == "in" else i
        i = expr(i)
        return expr(i + 1) if kind(i) == "<-" else i

    def alternative(i: int) -> int:
        i = expr(i)
        i = guards(i, "->") if kind(i) == "|" else expr(expect(i, "->"))
        return where(i)

    def guards(i: int, mark: str) -> int:
        while kind(i) == "|":
            while True:
                i = do_item(i + 1)
                if kind(i) != ",":
                    break
            i = expr(expect(i, mark))
        return i

    def where(i: int) -> int:
        if kind(i) == "where":
            i += 1
            return p.block(i, declaration) if k[i] != END and not p.stopped(i) else i
        return i

    def type_(i: int) -> int:
        while True:
            c = kind(i)
            if c == "forall":
                while kind(i) != "op":
                    i = expect(i + 1, "i") if kind(i + 1) == "i" else i + 1
                i += 1
                continue
            i += c in ("op", "~")
            i = type_atom(i)
            while kind(i) in ("i", "(", "[", "s", "n") or kind(i) == "op" and k[i + 1] in ("i", "(", "["):
                i = type_atom(i + (k[i] == "op"))
            if kind(i) not in ("->", "=>"):
                return i
            i += 1

    def type_atom(i: int) -> int:
        c = kind(i)
        if c in ("i", "s", "n"):
            return i + 1
        if c == "(":
            return p.bracketed(i + 1, lambda j: j + 1 if k[j] == "->" else j if k[j] == "," else signature(j), ")")
        if c == "[":
            return p.bracketed(i + 1, type_, "]")
        fail(i, "a type")

    def signature(i: int) -> int:
        i = type_(i)
        return type_(i + 1) if k[i] == "::" else i

    def declaration(i: int) -> int:
        c = k[i]
        if c in ("infix", "infixl", "infixr"):
            i += 1
            while not p.stopped(i):
                i += 1
            return i
        if c in ("type", "data", "newtype", "instance"):
            return data(i)
        i = expr(i)
        while kind(i) == "," :
            i = expr(i + 1)
        if k[i - 1] != "i" and kind(i) == "::" or kind(i) == "::":
            return type_(i + 1)
        if kind(i) == "=":
            i = expr(i + 1)
        elif kind(i) == "|":
            i = guards(i, "=")
        elif p.errors is not None and p_signature[0] == i:
            p_signature[0] = -1
            return i
        else:
            fail(i, "'='")
        return where(i)

    p_signature = [-1]
    plain_expr = expr

    def expr_or_signature(i: int) -> int:
        """As an item's head: ``name :: type`` is complete without '='."""
        start = i
        i = operand(i)
        while kind(i) == "op":
            i = operand(i + 1)
        if kind(i) == "::" :
            i = type_(i + 1)
            if not (k[start] == "(" and kind(i) == "="):
                p_signature[0] = i
        return i

    def data(i: int) -> int:
        """data, newtype, type, class, instance, deriving: types, constructors, members."""
        i += 1
        while kind(i) in ("instance", "family", "data"):
            i += 1
        i = type_(i)
        if kind(i) == "::":
            i = type_(i + 1)
        if kind(i) == "=":
            i += 1
            while True:
                i = type_(i)
                if kind(i) == "{":
                    i = p.bracketed(i + 1, record_field, "}")
                if kind(i) != "|":
                    break
                i += 1
        while kind(i) in ("|", ","):
            i = type_(i + 1)
        while kind(i) == "deriving":
            i += 1
            while kind(i) == "i" and kind(i + 1) in ("i", "("):
                i += 1
            i = type_atom(i)
        if kind(i) == "where":
            i += 1
            if not p.stopped(i) and k[i] != END:
                i = p.block(i, declaration)
        return i

    def record_field(i: int) -> int:
        i = expect(i, "i")
        while k[i] == "," and k[i + 2] in (",", "::"):
            i = expect(i + 1, "i")
        return type_(expect(i, "::") + (k[i + 1] == "op"))

    def top(i: int) -> int:
        c = k[i]
        if c == "module":
            i = expect(i + 1, "i")
            if k[i] == "(":
                i = skip_brackets(i)
            return expect(i, "where")
        if c == "import":
            i += 1
            while kind(i) == "i" or kind(i) == "s":
                i += 1
            if kind(i) == "(":
                i = skip_brackets(i)
            if not p.stopped(i):
                fail(i, "the end of an import")
            return i
        if c in ("data", "newtype", "type", "class", "instance", "deriving"):
            return data(i)
        if c == "default":
            return skip_brackets(i + 1)
        if c not in ("i", "(", "infix", "infixl", "infixr", "[", "op", "_"):
            fail(i, "a declaration")
        return declaration_item(i)

    def skip_brackets(i: int) -> int:
        depth = 0
        while True:
            depth += (k[i] in OPEN) - (k[i] in CLOSE)
            if k[i] == END:
                fail(i, "')'")
            i += 1
            if not depth:
                return i

    def declaration_item(i: int) -> int:
        return declaration_(i)

    def declaration_(i: int) -> int:
        start = i
        i = expr_or_signature(i)
        while kind(i) == ",":
            i = expr_or_signature(i + 1)
        if p_signature[0] == i:
            p_signature[0] = -1
            return i
        if kind(i) == "=":
            i = plain_expr(i + 1)
        elif kind(i) == "|":
            i = guards(i, "=")
        elif k[start] == "op" or k[start] == "(" :
            return i  # a splice or a section at the top
        else:
            fail(i, "'='")
        return where(i)

    declaration_ref = declaration_

    def declaration(i: int) -> int:  # noqa: F811 - the form used by blocks
        if k[i] in ("infix", "infixl", "infixr"):
            i += 1
            while not p.stopped(i):
                i += 1
            return i
        if k[i] in ("type", "data", "newtype", "instance"):
            return data(i)
        return declaration_ref(i)

    errors = p.run(top)
    found = [(tokens.line[min(at, len(tokens.line) - 1)], message) for at, message in errors]
    return sorted(found + _conflicts(tokens, text))


_FSHARP_LEVELS = [
    ":=", "<-", "||", "&&", ":> :?>", "= <> < > <= >= |> <| ||> << >> op | & @> >>= |>> ^ @", "::", ":?", "+ -", "* / %", "**",
]
_FSHARP_PRECEDENCE = {op: level for level, ops in enumerate(_FSHARP_LEVELS, 1) for op in ops.split() if op not in ("|", "&", "@>")}


def check_fsharp(text: str) -> list[tuple[int, str]]:
    tokens = _Tokens(_FSHARP_LEX, _FSHARP_CLASSES, text)
    p = _Offside(tokens)
    k, fail, expect, kind = p.k, p.fail, p.expect, p.kind
    begins = {"i", "n", "s", "(", "[", "[|", "{", "true", "false", "null", "_", "new", "!", "begin", "lazy", "'", "not"}

    def pattern(i: int) -> int:
        i = pattern_atom(i)
        while kind(i) in begins and kind(i) not in ("!", "new"):
            i = pattern_atom(i)
        while True:
            c = kind(i)
            if c in ("|", "&", "::", ","):
                i = pattern(i + 1)
            elif c == ":":
                i = type_(i + 1)
            elif c == "as":
                i = pattern(i + 1)
            elif c == ":?":
                i = type_(i + 1)
            else:
                return i

    def pattern_atom(i: int) -> int:
        c = kind(i)
        while c in ("mutable", "inline", "rec", "private", "internal", "public", "-", "?", "&", "struct"):
            i += 1
            c = kind(i)
        if c == ":?":
            return type_(i + 1)
        if c in ("i", "n", "s", "true", "false", "null", "_"):
            i += 1
            while kind(i) == ".i":
                i += 1
            if kind(i) == "<" :
                i = type_args(i)
            return i
        if c == "(":
            if k[i + 1] in ("op", "|", "=", "+", "-", "*", "/", "<", ">") or k[i + 1] in _FSHARP_PRECEDENCE:
                while k[i] not in (")", END):
                    i += 1
                return i + 1
            return p.bracketed(i + 1, pattern, ")")
        if c == "[":
            return p.bracketed(i + 1, pattern, "]", (";",))
        if c == "[|":
            return p.bracketed(i + 1, pattern, "|]", (";",))
        if c == "{":
            return p.bracketed(i + 1, lambda j: pattern(expect(expect_name(j), "=")), "}", (";",))
        fail(i, "a pattern")

    def expect_name(i: int) -> int:
        i = expect(i, "i")
        while k[i] == ".i":
            i += 1
        return i

    def type_args(i: int) -> int:
        depth = 0
        while True:
            c = k[i]
            if c == "<":
                depth += 1
            elif c in (">", ">>"):
                depth -= len(c)
            elif c == END or c in ("=", ")", "let"):
                fail(i, "'>'")
            i += 1
            if depth <= 0:
                return i

    def type_(i: int) -> int:
        while True:
            c = kind(i)
            if c in ("i", "_", "'", "#", "^"):
                i += 1 + (c in ("'", "#", "^"))
            elif c == "(":
                i = p.bracketed(i + 1, type_, ")", (",", ":"))
            elif c == "{":
                i = p.bracketed(i + 1, record_type, "}", (";",))
            elif c == "struct":
                i += 1
                continue
            else:
                fail(i, "a type")
            while True:
                c = kind(i)
                if c == ".i" or c == "i":
                    i += 1
                elif c == "<":
                    i = type_args(i)
                elif c == "[":
                    while k[i] in ("[", ",", "]"):
                        i += 1
                        if k[i - 1] == "]" and k[i] != "[":
                            break
                elif c == ":":
                    i = type_(i + 1)
                else:
                    break
            if kind(i) in ("->", "*"):
                i += 1
                continue
            return i

    def record_type(i: int) -> int:
        if k[i] == "}":
            return i
        i += k[i] == "attribute"
        i += k[i] == "mutable"
        i = type_(expect(expect(i, "i"), ":"))
        if k[i] not in ("}", ";") and p.first[i]:
            return record_type(i)
        return i

    def body(i: int) -> int:
        """A block of statements that must end with an expression."""
        last: list[str] = []

        def one(j: int) -> int:
            last[:] = [k[j]]
            return statement(j)

        i = p.block(i, one)
        if last and last[0] in ("let", "use"):
            fail(i, "an expression behind a binding")
        return i

    def atom(i: int) -> int:
        c = kind(i)
        if c in ("i", "n", "s", "true", "false", "null", "_"):
            i += 1
        elif c == "(":
            if k[i + 1] == ")":
                i += 2
            elif k[i + 1] != "-" and (k[i + 1] in _FSHARP_PRECEDENCE or k[i + 1] == "op") and k[i + 2] == ")":
                i += 3
            else:
                i = p.bracketed(i + 1, in_parens, ")", (",", ";", ":"))
        elif c == "[":
            i = p.bracketed(i + 1, in_list, "]", (";", ","))
        elif c == "[|":
            i = p.bracketed(i + 1, in_list, "|]", (";", ","))
        elif c == "{":
            i = p.bracketed(i + 1, in_record, "}", (";",))
        elif c == "begin":
            i = p.bracketed(i + 1, body, "end", ())
        elif c == "new":
            i = type_(i + 1)
        elif c in ("!", "'", "lazy", "not", "&"):
            return atom(i + 1)
        else:
            fail(i, "an expression")
        while True:
            c = kind(i)
            if c == ".i":
                i += 1
            elif c == ".[":
                i = p.bracketed(i + 1, in_list, "]", (",", ";"))
            elif c == "<" and k[i - 1] in ("i", ".i") and generic(i):
                i = type_args(i)
            elif c == "(" and k[i - 1] == ".i":
                i = atom(i)
            else:
                return i

    def generic(i: int) -> bool:
        j = i + 1
        while k[j] in ("i", ",", "_", "'", ".i", "*", "<"):
            j += 1
        return k[j] == ">" and k[j + 1] in ("(", ")", ".i", ">")

    def in_parens(i: int) -> int:
        if k[i] in (")", ","):
            return i
        if k[i] in ("fun", "function", "if", "match", "let", "for", "while", "try", "use"):
            i = body(i)
        else:
            i = expr(i)
        while p.first[i] and k[i] not in (")", ",") and k[i] != END and k[i] not in _FSHARP_PRECEDENCE and k[i] not in (":", ";"):
            i = statement(i)
        if k[i] == ":?>" or k[i] == ":>":
            i = type_(i + 1)
        return type_(i + 1) if k[i] == ":" else i

    def in_list(i: int) -> int:
        if k[i] in ("]", "|]"):
            return i
        if k[i] in ("for", "yield", "if", "let", "match", "while"):
            i = body(i)
        else:
            i = expr(i)
        while k[i] == "..":
            i += 1
            if k[i] not in ("]", "|]"):
                i = expr(i)
        while p.first[i] and k[i] not in ("]", "|]", ";", ",", END):
            i = in_list(i)
        return expr(i + 1) if k[i] == "->" else i

    def in_record(i: int) -> int:
        if k[i] == "}":
            return i
        if k[i] in ("let", "return", "yield", "do", "use", "match", "if", "for", "new", "inherit"):
            return body(i) if k[i] != "new" else object_expr(i)
        i = expr(i)
        if k[i] == "with":
            i = expr(i + 1)
        if p.first[i] and k[i] not in ("}", ";"):
            return in_record(i)
        return i

    def object_expr(i: int) -> int:
        i = atom(i)
        if k[i] in ("(", "with"):
            i = atom(i) if k[i] == "(" else i
            i = p.block(expect(i, "with"), member)
        return i

    def unary(i: int) -> int:
        c = kind(i)
        if c in ("-", "+", "~", "op", "&&", "*"):
            return unary(i + 1)
        if c == "fun":
            i += 1
            while kind(i) != "->":
                i = pattern_atom(i)
                if kind(i) == ",":
                    i += 1
            return body(i + 1)
        if c == "function":
            return rules(i + 1)
        if c == "if":
            return if_(i)
        if c == "match":
            i = expr_list(i + 1)
            return rules(expect_any(i, "with"))
        if c == "try":
            i = body(i + 1)
            if k[i] == "with":
                return rules(i + 1)
            if k[i] == "finally":
                return body(i + 1)
            fail(i, "'with' or 'finally'")
        if c == "for":
            i = pattern(i + 1)
            if k[i] == "=":
                i = expr(i + 1)
                if k[i] not in ("to", "downto"):
                    fail(i, "'to'")
                i = expr(i + 1)
            else:
                i = expr(expect(i, "in"))
                if k[i] == "..":
                    i = expr(i + 1)
                    if k[i] == "..":
                        i = expr(i + 1)
            if k[i] == "->":
                return body(i + 1)
            return body(expect_any(i, "do"))
        if c == "while":
            return body(expect_any(expr(i + 1), "do"))
        if c in ("return", "yield", "do", "assert", "upcast", "downcast"):
            return body(i + 1) if not p.stopped(i + 1) else fail(i + 1, "an expression")
        if c in ("let", "use"):
            return let(i)
        i = atom(i)
        while kind(i) in begins and not (p.first[i] and p.column[i] <= p.limit[-1]):
            i = atom(i)
        return i

    def expect_any(i: int, word: str) -> int:
        if k[i] != word:
            fail(i, repr(word))
        return i + 1

    def if_(i: int) -> int:
        at = p.column[i]
        i = expr(i + 1)
        i = body(expect_any(i, "then"))
        while k[i] in ("elif", "else") and not (p.first[i] and p.column[i] < p.limit[-1]):
            if k[i] == "else" and k[i + 1] != "if":
                return body(i + 1)
            i = expr(i + 1 + (k[i] == "else"))
            i = body(expect_any(i, "then"))
        return i

    def rules(i: int) -> int:
        i += k[i] == "|"
        while True:
            i = pattern(i)
            if k[i] == "when":
                i = expr(i + 1)
            i = body(expect(i, "->"))
            if k[i] != "|" or p.first[i] and p.column[i] < p.limit[-1]:
                return i
            i += 1

    def expr(i: int, least: int = 1) -> int:
        i = unary(i)
        while True:
            c = k[i]
            level = _FSHARP_PRECEDENCE.get(c)
            if level is None or level < least:
                return i
            if p.first[i] and p.column[i] < p.limit[-1]:
                return i
            if c in (":>", ":?>", ":?"):
                i = type_(i + 1)
            elif c == "<-" or c == ":=":
                return body(i + 1)
            elif kind(i + 1) in ("fun", "function", "if", "match"):
                i = unary(i + 1)
            else:
                i = expr(i + 1, level + 1)

    def expr_list(i: int) -> int:
        i = expr(i)
        while kind(i) == ",":
            i = expr(i + 1)
        return i

    def let(i: int) -> int:
        c = k[i]
        i += 1
        while kind(i) in ("rec", "mutable", "inline", "private", "internal", "public", "attribute"):
            i += 1
        i = pattern(i)
        if kind(i) == ":":
            i = type_(i + 1)
        i = body(expect(i, "="))
        while k[i] == "and" and not (p.first[i] and p.column[i] < p.limit[-1]):
            i = pattern(i + 1)
            i = body(expect(i, "="))
        if kind(i) == "in":
            return body(i + 1)
        return i

    def statement(i: int) -> int:
        if k[i] == "attribute":
            i += 1
        if k[i] in ("let", "use"):
            return let(i)
        i = expr_list(i)
        if kind(i) == "->" or not (p.first[i] or k[i] in CLOSE or k[i] in (";", ",", END, "then", "else", "elif", "with", "do", "done", "|", "->", "in", "finally", "to", "downto", "..", "|]", ":", "and", "end", "when")):
            fail(i, "the end of a statement")
        return i

    def member(i: int) -> int:
        """Of a type."""
        i += k[i] == "attribute"
        while k[i] in ("static", "private", "internal", "public", "inline"):
            i += 1
        c = k[i]
        if c in ("let", "do"):
            return let(i) if c == "let" else body(i + 1)
        if c in ("member", "override", "default", "abstract", "new", "val"):
            i += c != "new"
            while k[i] in ("private", "inline", "val", "mutable", "member", "internal"):
                i += 1
            if c == "abstract" or c == "val":
                i = type_(expect(expect(i, "i") if k[i] == "i" else i, ":"))
                return i
            i = expect(i, "i") if k[i] == "i" else i + 1
            while kind(i) == ".i":
                i += 1
            while kind(i) in ("(", "i", "_", "<"):
                i = type_args(i) if k[i] == "<" else pattern_atom(i)
            if kind(i) == ":":
                i = type_(i + 1)
            i = body(expect(i, "="))
            if k[i] == "with":
                i = p.block(i + 1, lambda j: body(expect(pattern(j), "=")))
            return i
        if c == "inherit":
            return expr(i + 1)
        if c == "interface":
            i = type_(i + 1)
            return p.block(i + 1, member) if k[i] == "with" else i
        if c == "|":
            return case(i)
        return statement(i)

    def case(i: int) -> int:
        while kind(i) == "|" or k[i] == "|":
            i = expect_name(i + 1)
            if kind(i) == "of":
                i = type_(i + 1)
            elif kind(i) == "=":
                i = expr(i + 1)
        return i

    def type_def(i: int) -> int:
        i += 1
        while k[i] in ("attribute", "private", "internal", "public", "rec"):
            i += 1
        i = expect_name(i)
        if kind(i) == "<":
            i = type_args(i)
        if kind(i) == "(":
            i = p.bracketed(i + 1, lambda j: pattern(j) if k[j] != ")" else j, ")")
        if kind(i) == "as":
            i += 2
        if kind(i) != "=":
            if kind(i) == "with":
                return p.block(i + 1, member)
            fail(i, "'='")
        i += 1
        if k[i] in ("class", "struct", "interface") and p.k[i + 1] != "i":
            i += 1
            while k[i] != "end":
                if k[i] == END:
                    fail(i, "'end'")
                i += 1
            return i + 1
        if k[i] == "{":
            i = p.bracketed(i + 1, record_type, "}", (";",))
        elif k[i] == "|":
            i = p.block(i, case)
        elif k[i] == "i" and not (k[i + 1] in ("|", "of")):
            i = type_(i)
        elif k[i] == "i":
            i += 1
            if k[i] == "of":
                i = type_(i + 1)
            i = case(i)
        else:
            return p.block(i, member)
        if kind(i) == "with":
            i += 1
        if not p.stopped(i) and k[i] in ("member", "override", "static", "interface", "abstract"):
            i = p.block(i, member)
        return i

    def top(i: int) -> int:
        c = k[i]
        if c == "attribute":
            return top(i + 1) if not p.stopped(i + 1) else i + 1
        if c in ("namespace", "open"):
            i += 1
            while k[i] in ("rec", "type", "global"):
                i += 1
            return expect_name(i) if k[i] == "i" else i
        if c == "module":
            i += 1
            while k[i] in ("rec", "private", "internal", "public"):
                i += 1
            i = expect_name(i)
            return p.block(i + 1, top) if kind(i) == "=" else i
        if c in ("type", "and"):
            return type_def(i)
        if c == "exception":
            i = expect(i + 1, "i")
            return type_(i + 1) if kind(i) == "of" else i
        if c in ("let", "use"):
            return let(i)
        if c == "do":
            return body(i + 1)
        if c == "i" and k[i + 1] not in (".i", "(", "|>", "<-", "s", "<", "n") or c not in ("i", "(", "[", "s", "for", "if", "match", "try", "while", "["):
            fail(i, "a declaration")
        return statement(i)

    errors = p.run(top)
    found = [(tokens.line[min(at, len(tokens.line) - 1)], message) for at, message in errors]
    return sorted(found + _conflicts(tokens, text))
