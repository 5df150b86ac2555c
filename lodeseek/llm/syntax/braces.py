"""Languages with braces: Rust, Java, C#, Go, JavaScript, TypeScript, TSX, Kotlin, Scala.

One family of grammars: statements by recursive descent, expressions by precedence climbing. A language is a set of
tables (keywords, operators, declarations) and a few switches where the languages really differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from lodeseek.llm.syntax.core import (
    CLOSE, END, TokenClasses, Unexpected, conflict_lines, located, match_brackets, operators_regex,
)

LANGUAGES = ("rust", "java", "csharp", "go", "javascript", "typescript", "tsx", "kotlin", "scala")

KEYWORDS = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod "
    "move mut pub ref return self Self static struct super trait true type unsafe use where while union",
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for goto "
    "if implements import instanceof interface native new package private protected public return static strictfp "
    "super switch synchronized this throw throws transient try void volatile while true false null",
    "csharp": "abstract as async await base break case catch checked class const continue default delegate do else enum event "
    "explicit extern false finally fixed for foreach goto if implicit in interface internal is lock namespace new null "
    "operator out override params partial private protected public readonly ref return sealed sizeof static struct "
    "record switch this throw true try typeof unchecked unsafe using virtual void volatile while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map "
    "package range return select struct switch type var",
    "javascript": "async await break case catch class const continue debugger default delete do else export extends "
    "finally for function if import in instanceof let new of return static super switch this throw try typeof "
    "var void while with yield null true false",
    "kotlin": "as break class continue do else false for fun if in interface is null object package return super this "
    "throw true try typealias typeof val var when while import",
    "scala": "abstract case catch class def do else extends false final finally for given if implicit import lazy "
    "match new null object override package private protected return sealed super then this throw trait try true type "
    "val var while with yield enum",
}
KEYWORDS["typescript"] = KEYWORDS["tsx"] = KEYWORDS["javascript"] + " interface enum as"

_COMMON = "+ - * / % = == != < > <= >= && || ! & | ^ ~ += -= *= /= %= &= |= ^= ( ) [ ] { } , ; : ? . @ # << <<= >>="
OPERATORS = {
    "rust": _COMMON + " -> => :: .. ..= ... ' $",
    "java": _COMMON + " -> :: ++ -- ...",
    "csharp": _COMMON + " => ?? ??= ++ -- :: -> .. ?[",
    "go": _COMMON + " := ++ -- <- ... &^ &^= >>",
    "javascript": _COMMON + " => ++ -- ** **= === !== ?? ??= ... >>> >> ?.( ?.[ &&= ||= #",
    "kotlin": _COMMON + " -> ++ -- .. ..< ?: !! :: ?. === !== ->",
    "scala": _COMMON + " => <- :: ::: ++ -> _ <: >: <% :+ +: ++= $ =>>",
}
OPERATORS["typescript"] = OPERATORS["tsx"] = OPERATORS["javascript"]

_LEVELS = [
    "= += -= *= /= %= &= |= ^= <<= >>= **= ??= &&= ||= := &^= ++= ->",
    "?: ??", "||", "&&", "|", "^", "& &^", "== != === !==", "< > <= >= instanceof is as in", ":: ::: :+ +: ++",
    ".. ..= ..<", "<< >> >>>", "+ -", "* / %", "**",
]
PRECEDENCE = {op: level for level, ops in enumerate(_LEVELS, 1) for op in ops.split()}
BINARY = {
    "rust": "= += -= *= /= %= &= |= ^= <<= >>= || && | ^ & == != < > <= >= as .. ..= << + - * / %",
    "java": "= += -= *= /= %= &= |= ^= <<= >>= || && | ^ & == != < > <= >= instanceof << + - * / %",
    "csharp": "= += -= *= /= %= &= |= ^= <<= >>= ??= ?? || && | ^ & == != < > <= >= is as in .. << + - * / %",
    "go": "|| && | ^ & &^ == != < > <= >= << >> + - * / %",
    "javascript": "= += -= *= /= %= &= |= ^= <<= >>= **= ??= &&= ||= ?? || && | ^ & == != === !== < > <= >= instanceof in "
    "<< >> >>> + - * / % **",
    "kotlin": "= += -= *= /= %= ?: || && == != === !== < > <= >= is as in .. ..< + - * / %",
    "scala": "= += -= *= /= %= ++= |= &= || && | ^ & == != < > <= >= :: ::: :+ +: ++ << >> -> + - * / %",
}
BINARY["typescript"] = BINARY["tsx"] = BINARY["javascript"] + " as"
PREFIX = {
    "rust": "- ! * & && mut ref box move dyn async unsafe .. ..=", "java": "- + ! ~ ++ --", "csharp": "- + ! ~ ++ -- & * await ref out in ^ ..",
    "go": "- + ! ^ * & <- ...", "javascript": "- + ! ~ ++ -- typeof void delete await ... yield", "kotlin": "- + ! ++ -- * ::",
    "scala": "- + ! ~",
}
PREFIX["typescript"] = PREFIX["tsx"] = PREFIX["javascript"]
POSTFIX = {
    "rust": "? !", "java": "++ --", "csharp": "++ -- !", "go": "...", "javascript": "++ --", "typescript": "++ -- !",
    "tsx": "++ -- !", "kotlin": "++ -- !!", "scala": "_",
}
MODIFIERS = {
    "rust": "pub async const unsafe extern default",
    "java": "public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed",
    "csharp": "public private protected internal static readonly abstract sealed virtual override async partial extern "
    "unsafe new volatile const event required file implicit explicit fixed ref",
    "javascript": "static async get set public private protected readonly abstract override declare accessor",
    "kotlin": "public private protected internal open abstract final override suspend inline data sealed inner lateinit "
    "const operator infix tailrec external annotation enum companion noinline crossinline vararg value expect actual reified",
    "scala": "private protected override final abstract sealed implicit lazy case inline open transparent infix opaque using",
}
MODIFIERS["typescript"] = MODIFIERS["tsx"] = MODIFIERS["javascript"]

_C_SKIP = r"[ \t\r\f\v﻿]|//[^\n]*|/\*[\s\S]*?\*/"
_NAME = r"[^\W\d]\w*"
_NUMBER = r"\d\w*(?:\.\d\w*)?(?:(?<=[eEpP])[+-]\d\w*)?"
_STRING = r'"(?:[^"\\\n]|\\[\s\S])*"'
_CHAR = r"'(?:[^'\\\n]|\\[^\n][^'\n]*)'"
_TRIPLE = r'"""[\s\S]*?"""+'
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|\$)*`"
_JS_REGEX = (
    r"(?:(?<=[(=,:\[!&|?{;])|(?<=[(=,:\[!&|?{;] )|(?<=return ))/(?![*/])"
    r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
)
_LITERALS = {
    "rust": rf'[bc]?r(#*)"[\s\S]*?"\2|b?{_STRING}|b?\'(?:[^\'\\\n]|\\[^\n][^\'\n]*)\'',
    "java": rf"{_TRIPLE}|{_STRING}|{_CHAR}",
    "csharp": rf'{_TRIPLE}|\$?@\$?"(?:[^"]|"")*"|\$?{_STRING}|{_CHAR}',
    "go": rf"`[^`]*`|{_STRING}|{_CHAR}",
    "javascript": rf"{_TEMPLATE}|{_STRING}|'(?:[^'\\\n]|\\[\s\S])*'|{_JS_REGEX}",
    "kotlin": rf"{_TRIPLE}|{_STRING}|{_CHAR}",
    "scala": rf"[a-z]*{_TRIPLE}|[a-z]*{_STRING}|{_CHAR}",
}
_LITERALS["typescript"] = _LITERALS["tsx"] = _LITERALS["javascript"]
#: Members are one token with their dot: ``.name``, ``?.name``; in Rust and C# also ``::name``.
_MEMBER = {
    "rust": rf"\.\s*(?:{_NAME}|\d+)|::\s*{_NAME}", "java": rf"\.\s*{_NAME}|::\s*(?:{_NAME})", "csharp": rf"\??\.\s*{_NAME}|::{_NAME}",
    "go": rf"\.\s*{_NAME}", "javascript": rf"\??\.\s*#?{_NAME}", "kotlin": rf"\??\.\s*{_NAME}|::\s*{_NAME}", "scala": rf"\.\s*(?:{_NAME})",
}
_MEMBER["typescript"] = _MEMBER["tsx"] = _MEMBER["javascript"]
_EXTRA_NAME = {"java": "", "csharp": rf"@{_NAME}|", "javascript": rf"#{_NAME}|", "kotlin": r"`[^`\n]+`|", "scala": r"`[^`\n]+`|", "rust": rf"'{_NAME}(?!')|r#{_NAME}|"}
_EXTRA_NAME["typescript"] = _EXTRA_NAME["tsx"] = _EXTRA_NAME["javascript"]

BY_LINE = {"go", "javascript", "typescript", "tsx", "kotlin", "scala"}


def lexer(language: str) -> re.Pattern:
    # A line that begins with a member goes on with the line before, also behind a few blank ones.
    goes_on = r"[ \t\r\n]{0,60}\??\.\s*[^\W\d]"
    line = rf"\n(?!{goes_on})|" if language in BY_LINE else ""
    skip = _C_SKIP + r"|\n" if not line else _C_SKIP + rf"|\n(?={goes_on})"
    name = _NAME.replace("[^\\W\\d]", "[^\\W\\d]|\\$") if language in ("javascript", "typescript", "tsx") else _NAME
    if name != _NAME:
        name = r"(?:[^\W\d]|\$)[\w$]*"
    return re.compile(
        rf"(?:{skip})*+(?:\Z|({line}{_LITERALS[language]}|{_EXTRA_NAME.get(language, '')}{name}|{_NUMBER}|{_MEMBER[language]}"
        rf"|{operators_regex(OPERATORS[language])}|[^\s]))"
    )


def checker(language: str) -> Callable[[str], list[tuple[int, str]]]:
    lex = lexer(language)
    grouped = lex.groups > 1
    keywords = set(KEYWORDS[language].split())
    classes = TokenClasses(keywords, set(OPERATORS[language].split()))
    by_line = language in BY_LINE

    def check(text: str) -> list[tuple[int, str]]:
        tokens = [m[0] for m in lex.findall(text)] if grouped else lex.findall(text)
        while tokens and not tokens[-1]:  # the end of the text
            tokens.pop()
        kinds = [classes[t] for t in tokens]
        if language in _JS:
            _names_in_disguise(kinds)
        kinds, match, places = match_brackets(kinds, by_line)
        errors = _parse(language, kinds, match)
        places += [len(tokens)] * 6
        found = located(lex, text, [(places[min(at, len(places) - 1)], message) for at, message in errors])
        marks = conflict_lines(text)
        if marks:
            found += _real_conflicts(lex, text, marks)
        return sorted(found)

    return check


def _names_in_disguise(kinds: list[str]) -> None:
    """Short reserved words at places where only a name makes sense: squeezing tools aren't always careful."""
    kinds.append(END)
    for i in [i for i, kind in enumerate(kinds) if kind in ("do", "if", "in")]:
        if kinds[i + 1] in (".i", "=", ",", ")", ";", "+", "*", "}", "]", "-") or kinds[i - 1] == "function":
            kinds[i] = "i"
    kinds.pop()


def _real_conflicts(lex: re.Pattern, text: str, marks: list[int]) -> list[tuple[int, str]]:
    """The marks that begin a token, that is, lie neither in a comment nor in a string."""
    starts, at = [], 0
    for line in text.split("\n"):
        starts.append(at)
        at += len(line) + 1
    wanted = {starts[n]: n for n in marks}
    return [(wanted[m.start(1)], "conflict mark") for m in lex.finditer(text) if m.start(1) in wanted]


_TABLES = {
    name: (
        {op: PRECEDENCE[op] for op in BINARY[name].split()},
        set(PREFIX[name].split()),
        set(POSTFIX[name].split()),
        set(MODIFIERS.get(name, "").split()),
        set(KEYWORDS[name].split()),
    )
    for name in LANGUAGES
}
_STOP = CLOSE | {END, ",", ";"}
_JS = {"javascript", "typescript", "tsx"}
_WORDS_AS_NAMES = {
    "rust": {"self", "Self", "super", "crate", "true", "false", "union", "await"},
    "java": {"this", "super", "true", "false", "null", "void"},
    "csharp": {"this", "base", "true", "false", "null", "void", "default", "record", "partial", "async", "await"},
    "go": set(),
    "javascript": {"this", "super", "true", "false", "null", "of", "async", "let", "static"},
    "kotlin": {"this", "super", "true", "false", "null"},
    "scala": {"this", "super", "true", "false", "null", "_"},
}
_WORDS_AS_NAMES["typescript"] = _WORDS_AS_NAMES["tsx"] = _WORDS_AS_NAMES["javascript"] | {"interface", "enum"}


def _parse(language: str, k: list[str], match: dict[int, int]) -> list[tuple[int, str]]:
    """Errors as (token, message). Functions take a token's index and return the index behind what they parsed."""
    precedence, prefix, postfix, modifiers, keywords = _TABLES[language]
    as_names = _WORDS_AS_NAMES[language]
    js = language in _JS
    typed_js = language in ("typescript", "tsx")
    jsx = language in ("javascript", "tsx")
    by_line = language in BY_LINE
    colon_types = typed_js or language in ("kotlin", "scala", "rust")
    type_first = language in ("java", "csharp")
    n = len(k)
    k += [END] * 6
    errors: list[tuple[int, str]] = []

    def fail(i: int, wanted: str):
        found = k[i]
        raise Unexpected(i, f"{wanted} expected, {'end of text' if found == END else found!r} found")

    def expect(i: int, kind: str) -> int:
        if k[i] != kind:
            fail(i, repr(kind))
        return i + 1

    def lines(i: int) -> int:
        while k[i] == "\n":
            i += 1
        return i

    def name(i: int) -> int:
        if k[i] == "i" or k[i] in as_names or js and (k[i] in keywords or k[i] == "s"):
            return i + 1
        fail(i, "a name")

    def listed(i: int, close: str, item: Callable[[int], int]) -> int:
        """Items and commas up to the closing bracket; i is behind the opening one."""
        i = lines(i)
        while k[i] != close:
            i = lines(item(i))
            if k[i] == ",":
                i = lines(i + 1)
            elif k[i] != close:
                fail(i, f"',' or {close!r}")
        return i + 1

    # -- types ------------------------------------------------------------------------------------------------------

    def type_args(i: int) -> int:
        """Behind '<': types up to '>'."""
        while k[i] != ">":
            if k[i] in ("in", "out", "const", "?", "*", "reified", "@"):
                i += 1
                if k[i] in (">", ","):
                    i += k[i] == ","
                    continue
            i = type_(i)
            if k[i] in ("extends", "super", ":", "=", "<:", ">:"):
                i = type_(i + 1)
            if k[i] == ">=":
                k[i] = "="
                return i
            if k[i] == ",":
                i += 1
            elif k[i] != ">":
                fail(i, "',' or '>'")
        return i + 1

    def type_(i: int) -> int:
        while k[i] in ("&", "*", "mut", "dyn", "impl", "&&", "const", "ref", "out", "in", "...", "chan", "<-", "=>", "final", "?", "async", "-", "for", "unsafe", "extern", "readonly"):
            if k[i] == "for" and k[i + 1] != "<":
                break
            i += 1
            if k[i - 1] == "for":
                i = type_args(i + 1)
            if k[i] == "i" and k[i - 1] in ("&", "&&") and k[i + 1] in ("i", "mut", "[", "dyn", "Self"):
                i += 1  # a lifetime
            if k[i - 1] == "?" and k[i] in (">", ","):
                return i
        c = k[i]
        if c == "i" or c in as_names or c in ("s", "n", "this", "void", "typeof", "new", "null", "_"):
            i += 1
            if c == "typeof" or c == "new" or c == "i" and k[i] in ("i", "{", "[") and typed_js and k[i] == "i":
                i = type_(i)
        elif c == "(":
            i = listed(i + 1, ")", parameter)
            if k[i] == "=>" and typed_js:
                return type_(i + 1)
        elif c == "[":
            if language == "go":
                if k[i + 1] != "]":
                    i = expr(i + 1, 2)
                    return type_(expect(i, "]"))
                return type_(i + 2)
            i = listed(i + 1, "]", type_)  if language != "rust" else type_(i + 1)
            if language == "rust":
                if k[i] == ";":
                    i = expr(i + 1, 1)
                i = expect(i, "]")
        elif c == "{" and (typed_js or language == "scala"):
            i = members(i + 1, member_js if typed_js else statement)
        elif c == "map":
            i = type_(expect(type_(expect(i + 1, "[")), "]"))
        elif c == "func" or c == "fn":
            i = listed(expect(i + 1, "("), ")", parameter)
            if k[i] == "->":
                return type_(i + 1)
            return type_(i) if language == "go" and k[i] in ("i", "(", "*", "[", "map") else i
        elif c in ("struct", "interface") and language == "go":
            i = members(expect(i + 1, "{"), field_go)
        elif c == "<" and language == "rust":
            i = type_args(i + 1)
        else:
            fail(i, "a type")
        while True:
            c = k[i]
            if c == "<":
                i = type_args(i + 1)
            elif c == ".i" or c == "?" or c == "!" and k[i - 1] == ">":
                i += 1
            elif c == "[" and language in ("go", "scala"):
                if language == "go" and k[i - 1] != "i":
                    return i
                i = listed(i + 1, "]", type_)
            elif c == "[":
                i += 1
                while k[i] == ",":
                    i += 1
                if k[i] != "]":
                    i = type_(i) if typed_js else expr(i, 1)
                i = expect(i, "]")
            elif c == "::":
                i += 1
                if k[i] == "<":
                    continue
            elif c in ("|", "&", "+", "with", "is", "as", "#") and (typed_js or c in ("with", "+", "&") and language in ("scala", "rust", "kotlin", "java")):
                i = type_(lines(i + 1))
            elif c in ("=>", "->") and language not in ("java", "csharp", "go") and not js:
                return type_(i + 1)
            elif c == "(" and language in ("rust",):
                i = listed(i + 1, ")", type_)
            elif c == "extends" and typed_js:
                i = type_(i + 1)
                if k[i] == "?":
                    i = type_(expect(type_(i + 1), ":"))
            else:
                return i

    def generic(i: int) -> int:
        return type_args(i + 1) if k[i] == "<" else listed(i + 1, "]", type_bound) if k[i] == "[" and language in ("go", "scala") else i

    def type_bound(i: int) -> int:
        while k[i] in ("+", "-"):
            i += 1
        i = name(i)
        if k[i] == "[":
            i = listed(i + 1, "]", type_)
        while k[i] in ("<:", ">:", ":", "|", "i", "~", "[", "*", "interface"):
            i = type_(i + (k[i] in ("<:", ">:", ":", "|", "~")))
        return i

    def annotation(i: int) -> int:
        """Behind '@': a name with arguments; in Rust and C# attributes are bracketed."""
        if k[i] == "interface":
            return i
        i = name(i)
        while k[i] in (".i", ":"):
            i += 1 if k[i] == ".i" else 2
        return arguments(i) if k[i] == "(" else i

    def attributes(i: int) -> int:
        while True:
            if k[i] == "@" and not (language == "java" and k[i + 1] == "interface"):
                i = lines(annotation(i + 1))
            elif k[i] == "#" and language == "rust":
                i = listed(expect(i + 1 + (k[i + 1] == "!"), "["), "]", attribute_item)
            elif k[i] == "[" and language == "csharp":
                i = listed(i + 1, "]", attribute_item)
            else:
                return i

    def attribute_item(i: int) -> int:
        if k[i + 1] == ":":
            i += 2
        return expr(i, 1)

    def parameter(i: int) -> int:
        i = lines(attributes(i))
        while k[i] in modifiers or k[i] in ("final", "params", "ref", "out", "in", "this", "val", "var", "mut", "const", "implicit", "vararg", "using"):
            if k[i + 1] in (",", ")", ":", "?", "="):
                break
            i += 1
        while (language == "kotlin" or typed_js) and k[i] == "i" and k[i + 1] in ("i", "val", "var"):
            i += 1 + (k[i + 1] != "i")
        if type_first:
            i = type_(i)
            if k[i] == "...":
                i += 1
            if k[i] not in (",", ")"):
                i = name(i) if k[i] != "this" else i + 1
            while k[i] == "[":
                i = expect(i + 1, "]")
            return expr(i + 1, 2) if k[i] == "=" else i
        if language == "go":
            if k[i] == "i" and k[i + 1] not in (",", ")", ".i", "["):
                i += 1
            elif k[i] == "i" and k[i + 1] == "[" and k[i + 2] in ("]", "n", "i") and k[match.get(i + 1, n) + 1] in ("i", "*", "[", "map", "func", "(", "interface", "struct", "chan"):
                i += 1
            return type_(i + (k[i] == "..."))
        if language == "rust":
            while k[i] in ("&", "mut", "self", "i") and (k[i] != "i" or k[i - 1] == "&"):
                i += 1
                if k[i - 1] == "self":
                    return type_(i + 1) if k[i] == ":" else i
            i = pattern(i)
            return type_(i + 1) if k[i] == ":" else i
        if k[i] == "...":
            i += 1
        if js and k[i] in ("{", "["):
            i = pattern(i)
        elif (k[i] in ("i", "_") or k[i] in as_names or js) and k[i] != "(":
            i = name(i)
            while k[i] in (".i", "[") and not js or k[i] == "<":
                i = generic(i) if k[i] != ".i" else i + 1
        else:
            i = type_(i)
        if k[i] == "?" and typed_js:
            i += 1
        if k[i] == ":" and colon_types:
            i = type_(i + 1)
            if k[i] == "*":
                i += 1
        elif k[i] in ("=>", "->") and language in ("kotlin", "scala"):
            i = type_(i + 1)
        return expr(i + 1, 2) if k[i] == "=" else i

    def parameters(i: int) -> int:
        return listed(expect(i, "("), ")", parameter)

    def pattern(i: int) -> int:
        """A binding: a name, or names in brackets, with defaults, alternatives and guards where a language has them."""
        while k[i] in ("&", "mut", "ref", "...", "..", "-", "box", "&&"):
            i += 1
            if k[i] in (",", ")", "]", "}"):
                return i
        c = k[i]
        if c in ("(", "["):
            i = listed(i + 1, ")" if c == "(" else "]", lambda j: j if k[j] == "," else pattern(j))
        elif c == "{":
            i = listed(i + 1, "}", pattern_field)
        elif c in ("i", "n", "s", "_") or c in as_names:
            i += 1
            while k[i] in (".i", "::"):
                i += 1
            if k[i] == "(":
                i = listed(i + 1, ")", pattern)
            elif k[i] == "{" and language == "rust":
                i = listed(i + 1, "}", pattern_field)
            if k[i] in ("..=", "..", "..."):
                i += 1
                if k[i] in ("n", "s", "i", "-"):
                    i = pattern(i)
            if k[i] == "@" and language in ("rust", "scala"):
                i = pattern(i + 1)
        else:
            fail(i, "a pattern")
        if k[i] == "|" and language in ("rust", "scala"):
            return pattern(lines(i + 1))
        if k[i] == ":" and language in ("scala", "kotlin"):
            i = type_(i + 1)
        if k[i] == "=" and js:
            return expr(i + 1, 2)
        return i

    def pattern_field(i: int) -> int:
        if k[i] in ("...", ".."):
            return i + 1 if k[i + 1] in CLOSE else pattern(i + 1)
        while k[i] in ("ref", "mut"):
            i += 1
        if k[i] == "[":
            i = expect(expr(i + 1, 1), "]")
        else:
            i = name(i)
        if k[i] == ":":
            i = pattern(i + 1)
        return expr(i + 1, 2) if k[i] == "=" and js else i

    # -- expressions ------------------------------------------------------------------------------------------------

    def argument(i: int) -> int:
        c = k[i]
        if language == "csharp" and c == "i" and k[i + 1] == ":":
            i += 2
        if c in ("ref", "out", "in") and language == "csharp" and k[i + 1] == "i" and k[i + 2] == "i":
            return i + 3
        if language == "go" and c in ("[", "map", "chan", "*", "func", "struct", "interface") and c != "*" and c != "func":
            i = type_(i)
            if k[i] in (",", ")"):
                return i
            if k[i] == "{":
                i = listed(i + 1, "}", element)
            elif k[i] == "(":
                i = arguments(i)
            return expr_rest(i, 1)
        if c == "*" and language == "kotlin":
            i += 1
        i = expr(i, 1)
        if k[i] == ":" and language == "scala":
            i = type_(i + 1)
            if k[i] == "*":
                i += 1
        if k[i] == "...":
            i += 1
        return i

    def arguments(i: int) -> int:
        i += 1
        if k[i] == ")":
            return i + 1
        while True:
            i = argument(i)
            c = k[i]
            if c == ",":
                i += 1
                if k[i] == ")":
                    return i + 1
            elif c == ")":
                return i + 1
            else:
                fail(i, "',' or ')'")

    def element(i: int) -> int:
        """Of a list, map or composite literal."""
        if k[i] == "{" and language in ("go", "java", "csharp"):
            i = listed(i + 1, "}", element)
        else:
            i = expr(i, 1)
        if k[i] == ":" and language == "go" or k[i] == "=>" :
            i = element(i + 1)
        return i

    def property_(i: int) -> int:
        """Of an object literal."""
        if k[i] == "...":
            return expr(i + 1, 2)
        while k[i] in ("async", "get", "set", "*", "static") and k[i + 1] not in (",", ":", "(", "}", "="):
            i += 1
        i = expect(expr(i + 1, 1), "]") if k[i] == "[" else i + 1 if k[i] == "n" else name(i)
        if k[i] == "(" or k[i] == "<":
            return function_rest(i)
        if k[i] == ":":
            return expr(lines(i + 1), 2)
        return expr(i + 1, 2) if k[i] == "=" else i

    def arrow_ahead(i: int) -> bool:
        """Whether '(' at i opens the parameters of an arrow function."""
        j = match.get(i)
        if j is None:
            return False
        c = k[j + 1]
        if c == "=>" or c == "->" and language == "java":
            return True
        if c == ":" and typed_js:
            try:
                return k[type_(j + 2)] == "=>"
            except Unexpected:
                return False
        return False

    def lambda_body(i: int) -> int:
        i = lines(i)
        if k[i] == "{" and not language == "scala":
            return block(i)
        return expr(i, 1)

    def braced_lambda(i: int) -> int:
        """Kotlin and Scala: parameters and arrow are optional; Scala's may be cases."""
        j = lines(i + 1)
        depth_end = match.get(i, n)
        m = j
        while m < depth_end and k[m] in ("i", ",", ":", ".i", "_", "(", ")", "?", "<", ">", "[", "]", "implicit"):
            m += 1
        if k[m] in ("->", "=>") and m > j and m < depth_end:
            j = m + 1
        elif k[j] in ("->", "=>"):
            j += 1
        return statements(j, "}")

    def primary(i: int) -> int:
        c = k[i]
        if c == "(":
            if (js or language in ("java", "csharp")) and arrow_ahead(i):
                i = lines(match[i] + 1) if not typed_js else arrow_head(i)
                return lambda_body(i + 1 if k[i] in ("=>", "->") else expect(type_(i + 1), "=>"))
            if language == "scala" and match.get(i) is not None and k[match[i] + 1] == "=>":
                return lambda_body(match[i] + 2)
            if type_first and match.get(i) is not None:
                j = match[i]
                if k[j + 1] in ("i", "n", "s", "(", "this", "new", "!", "~") and k[i + 1] in ("i", "void"):  # a cast
                    try:
                        if type_(i + 1) == j:
                            return unary(j + 1)
                    except Unexpected:
                        pass
            if k[i + 1] == ")":
                return i + 2
            return listed(i + 1, ")", argument)
        if c == "[":
            if language == "go":
                i = type_(i)
                return listed(i + 1, "}", element) if k[i] == "{" else arguments(i) if k[i] == "(" else i
            if language in ("kotlin", "java", "scala"):
                fail(i, "an expression")
            i = lines(i + 1)
            while k[i] == ",":
                i += 1
            i = listed(i, "]", lambda j: j if k[j] == "," else list_item(j))
            return i
        if c == "{":
            if js:
                return listed(i + 1, "}", property_)
            if language in ("kotlin", "scala"):
                return braced_lambda(i)
            if language == "rust":
                return block(i)
            if type_first:
                return listed(i + 1, "}", element)
        handler = PRIMARY.get(c)
        if handler:
            return handler(i)
        if c in as_names or c == "async" and js:
            return i + 1
        if c == "<" and jsx:
            return element_jsx(i)
        if c == "<" and language == "rust":
            return type_args(i + 1)
        if c in ("|", "||") and language == "rust":
            if c == "|":
                i += 1
                while k[i] != "|":
                    i = pattern(i)
                    if k[i] == ":":
                        i = type_(i + 1)
                    if k[i] == ",":
                        i += 1
                    elif k[i] != "|":
                        fail(i, "',' or '|'")
            i += 1
            return block(type_(i + 1)) if k[i] == "->" else expr(i, 1)
        if c == "'" and language == "rust":
            return i + 1
        fail(i, "an expression")

    def list_item(i: int) -> int:
        i = expr(i, 1)
        return expr(i + 1, 1) if k[i] == ";" and language == "rust" else i

    def arrow_head(i: int) -> int:
        return listed(i + 1, ")", parameter)

    def unary(i: int) -> int:
        while k[i] in prefix:
            i += 1
            if k[i - 1] in ("..", "..=", "yield") and (k[i] in _STOP or k[i] == "\n"):
                return i
        c = k[i]
        if c == "i":
            i += 1
            if k[i] == "=>" and (js or language in ("csharp", "scala")) or k[i] == "->" and language == "java":
                return lambda_body(i + 1)
        elif c == "n" or c == "s":
            i += 1
        else:
            i = primary(i)
        while True:
            c = k[i]
            if c == "(":
                i = arguments(i)
                if k[i] == "{" and language in ("kotlin", "scala") and (language == "kotlin" or k[i - 1] == ")") and not no_brace[0]:
                    i = braced_lambda(i)
            elif c == ".i":
                i += 1
                if k[i] == "s" and js:
                    i += 1
            elif c == "[" or c == "?[" or c == "?.[":
                i += 1
                if language in ("go", "csharp", "rust") and k[i] in (":", "..", "..="):
                    i += 1
                elif language == "scala":
                    i = listed(i, "]", type_)
                    continue
                while k[i] != "]":
                    i = expr(i, 1)
                    if k[i] in (":", ",", ".."):
                        i += 1
                    elif k[i] != "]":
                        fail(i, "']'")
                i += 1
            elif c == "?.(":
                i = arguments(i)
            elif c in postfix:
                if c == "!" and language == "rust":
                    if k[i + 1] not in ("(", "[", "{"):
                        break
                    i = macro(i + 1)
                    continue
                if c == "_" and language == "scala":
                    break
                i += 1
            elif c == "s" and js and k[i - 1] in ("i", ".i", ")"):  # a tagged template
                i += 1
            elif c == "::":
                i += 1
                if k[i] == "<":
                    i = type_args(i + 1)
                elif k[i] in ("i", "new", "class") or k[i] in as_names:
                    i += 1
                elif k[i] == "{":
                    i = listed(i + 1, "}", expr1)
                elif k[i] == "*":
                    i += 1
                elif language == "scala":
                    i -= 1
                    break
                else:
                    fail(i, "a name")
            elif c == "{" and k[i - 1] in ("i", ".i", ")", "]", ">") and not no_brace[0]:
                if language in ("kotlin", "scala") and k[i - 1] in ("i", ".i", ">"):
                    i = braced_lambda(i)
                elif language == "rust" and k[i - 1] in ("i", ".i", "Self") :
                    i = listed(i + 1, "}", struct_field)
                elif language == "go" and k[i - 1] in ("i", ".i", "]"):
                    i = listed(i + 1, "}", element)
                else:
                    break
            elif c == "<" and not by_line_generic(i):
                j = generic_call(i)
                if not j:
                    break
                i = j
            else:
                break
        return i

    def by_line_generic(i: int) -> bool:
        return language in ("javascript", "go", "scala", "rust") or k[i - 1] not in ("i", ".i") or k[i + 1] not in ("i", "s", "{", "(", "[", "?", "*")

    def generic_call(i: int) -> int:
        """Behind the type arguments of a call, or 0 if '<' is a comparison."""
        j = i + 1
        while k[j] in ("i", ",", ".i", "?", "[", "]", "<", "*", "extends", "s", "|"):
            j += 1
        if k[j] != ">" or k[j + 1] not in ("(", ">", ".i", "{", "::"):
            return 0
        while k[j] == ">":
            j += 1
        return j if k[j] in ("(", ".i", "{", "::") else 0

    def struct_field(i: int) -> int:
        if k[i] == "..":
            return expr(i + 1, 1) if k[i + 1] != "}" else i + 1
        i = lines(attributes(i))
        i = i + 1 if k[i] == "n" else name(i)
        return expr(i + 1, 1) if k[i] == ":" else i

    def macro(i: int) -> int:
        """The arguments of a Rust macro are any balanced tokens."""
        end = match.get(i)
        if end is None:
            fail(n, "the end of a macro")
        return end + 1

    def expr1(i: int) -> int:
        return expr(i, 1)

    def expr(i: int, least: int) -> int:
        c = k[i]
        if c == "i" or c == "n" or c == "s":  # the common case: an operand followed by an operator or the end
            c = k[i + 1]
            if c in simple_follow:
                i += 1
            else:
                i = unary(i)
                c = k[i]
        else:
            i = unary(i)
            c = k[i]
        level = precedence.get(c)
        while level is not None and level >= least:
            if c in ("as", "is", "instanceof"):
                i = cast_type(i)
            else:
                i += 1
                if c == ">":
                    while k[i] == ">" or k[i] == ">=":
                        i += 1
                elif c == "in" or c == "=" or by_line:
                    while k[i] == "\n":
                        i += 1
                if (c == ".." or c == "..=") and (k[i] in _STOP or k[i] == "{"):
                    c = k[i]
                    level = precedence.get(c)
                    continue
                if c == "=" and language == "go" and k[i] in ("[", "map"):
                    i = argument(i)
                else:
                    i = expr(i, level if level == 1 else level + 1)
            c = k[i]
            level = precedence.get(c)
        return expr_rest(i, least) if c in ternary_like else i

    def cast_type(i: int) -> int:
        op = k[i]
        i += 1
        if k[i] in ("?", "!"):
            i += 1
        if language == "csharp" and k[i] in ("null", "n", "s", "not", "{", "<", ">", "-"):
            while k[i] in ("not", "<", ">", "<=", ">="):
                i += 1
            return unary(i)
        if typed_js and k[i] == "const":
            return i + 1
        if op == "is" and language == "kotlin" and k[i] == "in":
            i += 1
        # A type here ends before '<' of a comparison unless it closes.
        i = name(i) if k[i] == "i" and k[i + 1] in ("<", "&", "|", "?") and not generic_call(i + 1) else type_(i)
        return i + 1 if k[i] == "i" and type_first else i

    def expr_rest(i: int, least: int) -> int:
        c = k[i]
        if c == "?" and language in ("java", "csharp", "javascript", "typescript", "tsx") and least <= 2:
            i = expr(lines(i + 1), 1 if js else 2)
            i = expr(lines(expect(lines(i), ":") if by_line else expect(i, ":")), 2)
            return expr_rest(i, least) if k[i] in ternary_like else i
        if c == "\n" and (js or language in ("kotlin", "scala")):
            j = lines(i)
            d = k[j]
            if d in continuing and not (d == "?" and not js) or d == "?" and js:
                return expr_more(j, least)
            return i
        if c == "switch" and language == "csharp":
            return listed(expect(i + 1, "{"), "}", switch_arm)
        if c == "with" and language == "csharp":
            return listed(expect(i + 1, "{"), "}", element)
        if c == "match" and language == "scala":
            return expr_more(block_cases(expect(i + 1, "{")), least)
        if c == "!" and language == "kotlin" and k[i + 1] in ("in", "is"):
            return expr_more(cast_type(i + 1) if k[i + 1] == "is" else expr(i + 2, 8), least)
        if c == "i" and language in ("kotlin", "scala") and k[i + 1] in ("i", "n", "s", "(", "-", "!", "this", "{", "true", "false") and least <= 11:
            return expr_more(expr(i + 1, 11), least)  # an infix function
        if c == "{" and language == "scala" and not no_brace[0] and k[i - 1] == ")":
            return i
        return i

    def expr_more(i: int, least: int) -> int:
        """Go on behind an operand that is already parsed."""
        c = k[i]
        level = precedence.get(c)
        while level is not None and level >= least:
            i = cast_type(i) if c in ("as", "is", "instanceof") else expr(lines(i + 1), level + 1 if level > 1 else level)
            c = k[i]
            level = precedence.get(c)
        return expr_rest(i, least) if c in ternary_like else i

    def switch_arm(i: int) -> int:
        while k[i] not in ("=>", END, "}"):
            i = match[i] + 1 if i in match else i + 1
        return expr(expect(i, "=>"), 1)

    def header(i: int) -> int:
        """The condition of a statement without brackets around it: a brace behind it opens the body."""
        before, no_brace[0] = no_brace[0], True
        try:
            return expr(i, 1)
        finally:
            no_brace[0] = before

    def bracketed(i: int, item: Callable[[int], int]) -> int:
        """'(' item ')'; braces inside belong to expressions again."""
        before, no_brace[0] = no_brace[0], False
        try:
            return expect(lines(item(lines(expect(i, "(")))), ")")
        finally:
            no_brace[0] = before

    no_brace = [False]

    # -- JSX --------------------------------------------------------------------------------------------------------

    def element_jsx(i: int) -> int:
        i += 1
        if k[i] != ">":
            i = name(i)
            while k[i] in (".i", "-", ":", "i") and not (k[i] == "i" and k[i - 1] not in ("-", ":")):
                i += 1
            while k[i] not in (">", "/"):
                i = lines(i)
                if k[i] == "{":
                    i = expect(lines(expr(lines(i + 1), 1)), "}")
                else:
                    i = name(i)
                    while k[i] == "-":
                        i = name(i + 1)
                    if k[i] == "=":
                        i = i + 2 if k[i + 1] == "s" else expect(lines(expr(lines(expect(i + 1, "{")), 1)), "}")
                i = lines(i)
            if k[i] == "/":
                return expect(i + 1, ">")
        i += 1
        while not (k[i] == "<" and k[i + 1] == "/"):
            if k[i] == "{":
                j = lines(i + 1)
                i = expect(lines(expr(j, 1)) if k[j] != "}" else j, "}")
            elif k[i] == "<":
                i = element_jsx(i)
            elif k[i] == END or k[i] == "}":
                fail(i, "the end of an element")
            else:
                i += 1
        i += 2
        while k[i] in ("i", ".i", "-", ":"):
            i += 1
        return expect(i, ">")

    # -- statements -------------------------------------------------------------------------------------------------

    def ended(i: int) -> int:
        """The end of a simple statement."""
        c = k[i]
        if c == ";" or c == "\n" and by_line:
            return i + 1
        if by_line and (c == "}" or c == END) or language == "rust" and c == "}":
            return i
        if language == "rust" and k[i - 1] == "}" or language == "csharp" and k[i - 1] == "}" and c in ("}", END):
            return i
        fail(i, "the end of a statement")

    def recover(i: int, inside: bool) -> int:
        """Panic mode: skip to what may begin the next statement, over whole brackets."""
        while k[i] != END:
            c = k[i]
            if c == "}" and inside:
                return i
            if i in match:
                i = match[i] + 1
                if c == "{":
                    return i
                continue
            i += 1
            if c == ";" or c == "\n" and by_line or k[i] in DECLARATIONS and c in ("}", "\n"):
                return i
        return i

    def statements(i: int, close: str, one: Callable[[int], int] | None = None) -> int:
        """Statements up to ``close``, which is consumed; errors are noted and skipped."""
        one = one or statement
        while True:
            c = k[i]
            while c == "\n" or c == ";":
                i += 1
                c = k[i]
            if c == close:
                return i + 1
            if c == END:
                fail(i, repr(close))
            i = guarded(one, i, True)

    def guarded(one: Callable[[int], int], i: int, inside: bool) -> int:
        try:
            return one(i)
        except Unexpected as e:
            if e.at >= n or not inside and k[i] == END:
                raise
            errors.append((e.at, e.message))
            no_brace[0] = False
            j = recover(max(e.at, i), inside)
            return j if j > i else i + 1

    def block(i: int) -> int:
        before, no_brace[0] = no_brace[0], False
        i = statements(expect(lines(i), "{"), "}")
        no_brace[0] = before
        return i

    def members(i: int, one: Callable[[int], int]) -> int:
        before, no_brace[0] = no_brace[0], False
        i = statements(i, "}", one)
        no_brace[0] = before
        return i

    def body(i: int) -> int:
        """The body of if, for, while: a block or one statement."""
        if k[i] == "{":
            return block(i)
        if language in ("go", "rust"):
            fail(i, "'{'")
        j = lines(i)
        return block(j) if k[j] == "{" and language != "scala" else i + 1 if k[i] == ";" else statement(j)

    def if_(i: int) -> int:
        i += 1
        if language in ("go", "rust"):
            i = header_let(i)
            if k[i] == ";" and language == "go":
                i = header_let(i + 1)
        else:
            i = bracketed(i, expr1)
            if k[i] == "then":
                i += 1
        if language in ("kotlin", "scala") and k[lines(i)] != "{":
            i = statement_bare(lines(i))
        else:
            i = body(i)
        j = lines(i) if language != "go" else i
        if k[j] == ";" and language in ("kotlin", "scala") and k[lines(j + 1)] == "else":
            j = lines(j + 1)
        if k[j] == "else":
            j += 1
            if k[lines(j)] == "if":
                return if_(lines(j))
            if language in ("kotlin", "scala") and k[lines(j)] != "{":
                return statement_bare(lines(j))
            return body(j)
        return i

    def statement_bare(i: int) -> int:
        """A statement as part of an expression: without its end."""
        handler = STATEMENTS.get(k[i])
        if handler and k[i] in ("return", "throw", "break", "continue"):
            return jump(i)
        return handler(i) if handler else expr(i, 1)

    def header_let(i: int) -> int:
        """A condition of Go or Rust: an expression, or a binding."""
        if k[i] == "let":
            i = expect(pattern(i + 1), "=")
            i = header(i)
            return header_let(i + 1) if k[i] == "&&" else i
        if language == "go":
            return simple_go(i, header)
        return header(i)

    def jump(i: int) -> int:
        """return, break, continue, throw with an optional value; the end isn't consumed."""
        i += 1
        if k[i] in ("@", "'"):
            i += 2
        if k[i] in (";", "\n", "}", END, ",", ")", "else", "=>"):
            return i
        if js and k[i - 1] in ("break", "continue") or language in ("kotlin", "go", "java", "csharp") and k[i - 1] in ("break", "continue"):
            return name(i)
        i = expr(i, 1)
        while k[i] == "," and (language == "go" or js):
            i = expr(lines(i + 1), 1)
        return i

    def jump_statement(i: int) -> int:
        return ended(jump(i))

    def variable(i: int) -> int:
        """var, let, const, val with patterns, types and values; the end isn't consumed."""
        i += 1
        if language == "rust":
            i = pattern(i)
            if k[i] == ":":
                i = type_(i + 1)
            if k[i] == "=":
                i = expr(i + 1, 1)
                if k[i] == "else":
                    i = block(i + 1)
            return i
        if language == "kotlin":
            i = generic(i)
        while True:
            i = pattern(i) if js or language != "kotlin" else type_(i) if k[i] == "i" and k[i + 1] in (".i", "<") else pattern(i)
            if k[i] == "!" and typed_js:
                i += 1
            if k[i] == ":" and colon_types:
                i = type_(i + 1)
            if k[i] in ("=", "i") and (k[i] == "=" or language == "kotlin"):
                i = expr(lines(i + 1), 2 if js else 1)
            if k[i] in ("in", "of"):
                return i
            if k[i] != ",":
                return i
            i = lines(i + 1)

    def variable_statement(i: int) -> int:
        return ended(variable(i))

    def for_(i: int) -> int:
        i += 1
        if language == "go":
            if k[i] != "{":
                if k[i] != ";":
                    i = range_go(i)
                if k[i] == ";":
                    i += 1
                    if k[i] != ";":
                        i = header(i)
                    i = expect(i, ";")
                    if k[i] != "{":
                        i = simple_go(i, header)
            return block(i)
        if language == "rust":
            return block(header(expect(pattern(i), "in")))
        if k[i] == "await" and js:
            i += 1
        if language == "scala" and k[i] == "{":
            i = statements(i + 1, "}", generator)
        elif language == "scala":
            i = bracketed(i, generators)
        else:
            i = bracketed(i, for_header)
        if language == "scala" and k[lines(i)] == "yield":
            return expr(lines(i) + 1, 1)
        return body(i)

    def generator(i: int) -> int:
        if k[i] == "if":
            i = expr(i + 1, 1)
        else:
            i = pattern(i)
            i = expr(expect(i, "<-") if k[i] != "=" else i + 1, 1)
            if k[i] == "if":
                i = expr(i + 1, 1)
        return i + 1 if k[i] in (";", "\n") else i

    def generators(i: int) -> int:
        while k[i] != ")":
            i = generator(i)
        return i

    def for_header(i: int) -> int:
        if language == "kotlin":
            return expr(expect(pattern(attributes(i)), "in"), 1)
        if k[i] != ";":
            if k[i] in ("var", "let", "const") and js:
                i = variable(i)
            elif type_first and declares(i):
                i = type_(i + (k[i] == "final"))
                i = name(i)
                if k[i] == ":":
                    return expr(i + 1, 1)
                i = declarators(i) if k[i] in ("=", ",", ";") else i
            else:
                i = expr(i, 1)
                while k[i] == ",":
                    i = expr(i + 1, 1)
            if k[i] in ("in", "of"):
                return expr(i + 1, 1)
        i = expect(i, ";")
        if k[i] != ";":
            i = expr(i, 1)
        i = expect(i, ";")
        while k[i] != ")":
            i = expr(i, 1)
            if k[i] == ",":
                i += 1
        return i

    def while_(i: int) -> int:
        if language == "rust":
            return block(header_let(i + 1))
        return body(bracketed(i + 1, expr1))

    def do_(i: int) -> int:
        i = lines(body(i + 1))
        return ended(bracketed(expect(i, "while"), expr1)) if not by_line or k[i] == "while" else i

    def try_(i: int) -> int:
        i += 1
        if k[i] == "(":
            i = bracketed(i, resources)
        i = block(i) if language != "scala" or k[i] == "{" else expr(i, 1)
        handlers = 0
        while True:
            j = lines(i)
            if k[j] == "catch":
                j += 1
                if language == "scala":
                    i = block_cases(expect(j, "{"))
                else:
                    if k[j] == "(":
                        j = bracketed(j, caught)
                    if k[j] == "i" and language == "csharp":
                        j = bracketed(j + 1, expr1)
                    i = block(j)
            elif k[j] == "finally":
                i = block(j + 1) if k[j + 1] == "{" else expr(j + 1, 1)
            else:
                if not handlers and language not in ("java", "scala"):
                    fail(j, "'catch' or 'finally'")
                return i
            handlers += 1

    def resources(i: int) -> int:
        while k[i] != ")":
            i = expr(name(type_(i + (k[i] == "final"))) + 1, 1) if declares(i) else expr(i, 1)
            if k[i] == ";":
                i += 1
        return i

    def caught(i: int) -> int:
        if js:
            i = pattern(i)
            return type_(i + 1) if k[i] == ":" else i
        if language == "kotlin":
            return type_(expect(name(i), ":"))
        i = type_(i + (k[i] == "final"))
        while k[i] == "|":
            i = type_(i + 1)
        return i + 1 if k[i] == "i" else i

    def switch_(i: int) -> int:
        i += 1
        if language == "go":
            if k[i] != "{":
                i = header_let(i)
                if k[i] == ";":
                    i = header_let(i + 1) if k[i + 1] != "{" else i + 1
        else:
            i = bracketed(i, expr1)
        return block_cases(expect(lines(i), "{"))

    def select_(i: int) -> int:
        return block_cases(expect(i + 1, "{"))

    def block_cases(i: int) -> int:
        before, no_brace[0] = no_brace[0], False
        i = statements(i, "}", case_or_statement)
        no_brace[0] = before
        return i

    def case_or_statement(i: int) -> int:
        if k[i] == "case" and k[i + 1] not in ("class", "object"):
            if language == "scala":
                i = pattern(i + 1)
                if k[i] == "if":
                    i = expr(i + 1, 2)
                return expect(i, "=>")
            i += 1
            while True:
                if language == "go":
                    i = simple_go(i, expr1)
                elif type_first and declares(i):
                    i = name(type_(i))
                else:
                    i = expr(i, 2)
                if k[i] == "i" and language == "csharp":
                    i = expr(i + 1, 2)
                if k[i] != ",":
                    break
                i = lines(i + 1)
            if k[i] == "->" and language == "java":
                return i + 1
            return expect(i, ":")
        if k[i] == "default" and k[i + 1] in (":", "->"):
            return i + 2
        return statement(i + (k[i] == "case"))

    def when_(i: int) -> int:
        i += 1
        if k[i] == "(":
            i = bracketed(i, lambda j: expr(expect(name(j + 1), "="), 1) if k[j] == "val" else expr(j, 1))
        return statements(expect(lines(i), "{"), "}", when_arm)

    def when_arm(i: int) -> int:
        while k[i] != "->":
            if k[i] == "else":
                i += 1
            elif k[i] in ("is", "in") or k[i] == "!" and k[i + 1] in ("is", "in"):
                i += k[i] == "!"
                i = type_(i + 1) if k[i] == "is" else expr(i + 1, 2)
            else:
                i = expr(i, 2)
            if k[i] == ",":
                i = lines(i + 1)
            elif k[i] != "->":
                fail(i, "'->'")
        i = lines(i + 1)
        i = block(i) if k[i] == "{" else statement_bare(i)
        return i + 1 if k[i] in ("\n", ";") else i

    def match_(i: int) -> int:
        i = header(i + 1)
        before, no_brace[0] = no_brace[0], False
        i = expect(i, "{")
        while k[i] != "}":
            i = attributes(i)
            if k[i] == "|":
                i += 1
            i = pattern(i)
            if k[i] == "if":
                i = expr(i + 1, 1)
            i = expect(i, "=>")
            blocky = k[i] == "{"
            i = block(i) if blocky and k[match.get(i, n) + 1] in (",", "}", "i", "_", "n", "s", "&", "(") else statement_bare(i)
            if k[i] == ",":
                i += 1
            elif k[i] != "}" and not blocky and k[i - 1] != "}":
                fail(i, "',' or '}'")
        no_brace[0] = before
        return i + 1

    # -- declarations -----------------------------------------------------------------------------------------------

    def function_rest(i: int) -> int:
        """Type parameters, parameters, result, body or none."""
        i = parameters(generic(i))
        while k[i] == "(" and language == "scala":
            i = parameters(i)
        if k[i] == ":" and (typed_js or language in ("kotlin", "scala")):
            i = type_(i + 1)
        if k[i] == "->" and language == "rust":
            i = type_(i + 1)
        if language == "go" and k[i] not in ("{", "\n", ";", END, ")", ",", "}"):
            i = type_(i)
        i = where(i)
        if k[i] == "throws":
            i = type_(i + 1)
            while k[i] == ",":
                i = type_(i + 1)
        if k[i] == "default" and language == "java":
            i = expr(i + 1, 1)
        if k[i] == "=>" and language == "csharp":
            return expect(expr(i + 1, 1), ";")
        if k[i] == "=" and language in ("kotlin", "scala"):
            i = lines(i + 1)
            return block(i) if k[i] == "{" and language == "scala" else statement_bare(i)
        if k[i] == ":" and language == "csharp":
            i = arguments(i + 2)
        if k[i] == "{":
            return block(i)
        if js and language == "javascript":
            fail(i, "'{'")
        if k[i] == ";":
            return i + 1
        if by_line and (k[i] in ("\n", "}") or k[i] == END and language in ("kotlin", "scala")) and language != "javascript":
            j = lines(i)
            return block(j) if k[j] == "{" and language in ("kotlin", "typescript", "tsx") else i
        fail(i, "a body")

    def where(i: int) -> int:
        while k[lines(i)] == "where" or k[i] == "i" and language in ("csharp", "kotlin") and k[i + 1] == "i" and k[i + 2] == ":":
            i = lines(i) + 1
            while k[i] != "{" and k[i] not in (";", "=", "where", END):
                if k[i] == "(":
                    i = match.get(i, i) + 1
                elif k[i] in CLOSE:
                    fail(i, "'{'")
                else:
                    i += 1
        return i

    def function(i: int) -> int:
        i += 1
        if k[i] == "*":
            i += 1
        if language == "go" and k[i] == "(":
            i = parameters(i)
        if language == "kotlin":
            i = generic(i)
            if k[i] == "(":
                return function_rest(i)
            i = name(i)
            while k[i] in (".i", "<", "?"):
                i = generic(i) if k[i] == "<" else i + 1
            return function_rest(i)
        if k[i] != "(":
            i = i + 1 if language == "scala" and k[i] not in ("\n", "{", "(") else name(i)
        if language == "scala":
            i = generic(i)
            if k[i] != "(":
                if k[i] == ":":
                    i = type_(i + 1)
                return statement_bare(lines(i + 1)) if k[i] == "=" and k[lines(i + 1)] != "{" else block(lines(i + 1)) if k[i] == "=" else i
        return function_rest(i)

    def bases(i: int) -> int:
        """What follows a type's name: parameters, supertypes, constraints."""
        while True:
            c = k[i]
            if c in ("extends", "implements", "with", ":", "permits") or c == "," :
                i = lines(i + 1)
                i = type_(i)
                if k[i] == "(":
                    i = arguments(i)
                if k[i] == "i" and language == "kotlin":
                    i = unary(i + 1)
            elif c == "i" and language in ("java", "kotlin", "typescript", "tsx") and k[i + 1] == "i":
                i = type_(i + 1)
            elif c == "(":
                i = parameters(i)
            elif c in modifiers or c == "@":
                i = attributes(i) if c == "@" else i + 1
            elif c == "\n" and k[lines(i)] in ("extends", "with", "implements", ":"):
                i = lines(i)
            else:
                return where(i)

    def class_(i: int) -> int:
        """class, interface, trait, object, enum, struct, record: head and body."""
        kind = k[i]
        i += 1
        if kind in ("enum", "record") and k[i] in ("class", "struct"):
            i += 1
        if kind == "@":
            i += 1
        if k[i] in ("i",) or k[i] in as_names:
            i += 1
        elif kind not in ("object", "class") or language not in ("kotlin", "javascript", "typescript", "tsx"):
            fail(i, "a name")
        i = bases(generic(i))
        j = lines(i)
        if k[j] == "{" and not (by_line and j > i + 1):
            j += 1
            if kind == "enum" and language in ("java", "kotlin", "csharp", "typescript", "tsx"):
                return enum_body(j, language in ("java", "kotlin"))
            return members(j, member)
        if k[i] == ";":
            return i + 1
        if language in ("kotlin", "scala") and k[i] in ("\n", END, "}", ")"):
            return i
        fail(i, "'{'")

    def enum_body(i: int, more: bool) -> int:
        i = lines(i)
        while k[i] not in ("}", ";"):
            i = name(lines(attributes(i)))
            if k[i] == "(":
                i = arguments(i)
            if k[i] == "=":
                i = expr(i + 1, 2)
            if k[i] == "{":
                i = members(i + 1, member)
            i = lines(i)
            if k[i] == ",":
                i = lines(i + 1)
            elif k[i] not in ("}", ";"):
                fail(i, "',' or '}'")
        if k[i] == ";" and more:
            return members(i + 1, member)
        return expect(i, "}")

    def declares(i: int) -> bool:
        """Java and C#: whether a type and a name follow."""
        c = k[i]
        if c == "final" or c == "const" or c == "ref":
            return True
        if c != "i" and c != "void" and c != "(":
            return False
        if k[i + 1] == "i":
            return k[i + 2] in ("=", ";", ",", "(", ":", "[", "{", "in", "<", ")", "=>")
        if k[i + 1] == "(" or c == "(" and language == "java":
            return False
        try:
            j = type_(i)
        except Unexpected:
            return False
        return k[j] == "i" and k[j + 1] in ("=", ";", ",", "(", ":", "[", "{", "in", "<", ")", "=>")

    def declarators(i: int) -> int:
        """Behind the first name of a declaration: values and further names."""
        while True:
            while k[i] == "[":
                i = expect(i + 1, "]")
            if k[i] == "=":
                i = listed(i + 2, "}", element) if k[i + 1] == "{" else expr(i + 1, 2)
            if k[i] != ",":
                return i
            i = name(i + 1)

    def member(i: int) -> int:
        if js:
            return member_js(i)
        if type_first:
            return member_typed(i)
        return statement(i)

    def member_js(i: int) -> int:
        i = lines(attributes(i))
        if k[i] == "{":
            return block(i)
        while (k[i] in modifiers or k[i] == "*" or k[i] == "i" and k[i + 1] in ("i", "[", "*", "s")) and k[i + 1] not in ("(", "=", ";", ":", ",", "?", "<", "}", "\n"):
            i += 1
            if k[i] == "{":
                return block(i)
        if k[i] == "+" or k[i] == "-":
            i += 2
        if k[i] == "[":
            i = expr(i + 1, 1)
            if k[i] in (":", "in"):
                i = type_(i + 1)
            i = expect(i, "]")
        elif k[i] == "n":
            i += 1
        elif k[i] not in ("(", "<"):
            i = name(i)
        while k[i] in ("?", "!", "-", "+"):
            i += 1
        if k[i] in ("(", "<"):
            i = function_rest(i)
            return i + 1 if k[i] in (",", ";") else i
        if k[i] == ":" and typed_js:
            i = type_(lines(i + 1))
        if k[i] == "=":
            i = expr(lines(i + 1), 2)
        return i + 1 if k[i] == "," else ended(i)

    def member_typed(i: int) -> int:
        """A member of a Java or C# class."""
        i = attributes(i)
        while k[i] in modifiers or k[i] == "i" and k[i + 1] in ("class", "interface", "struct", "enum") or k[i] == "@" and k[i + 1] != "interface":
            i = i + 1 if k[i] != "@" else annotation(i + 1)
        c = k[i]
        if c == "{":
            return block(i)
        if c in TYPES and (c != "record" or k[i + 1] in ("i", "class", "struct")) or c == "@":
            return class_(i)
        if c == "i" and k[i + 1] == "i" and k[i + 2] == "(" and language == "java" and k[match.get(i + 2, n) + 1] == "implements":
            return class_(i)
        if c == "delegate":
            i = name(type_(i + 1))
            return expect(parameters(generic(i)), ";")
        if c == "namespace" or c == "using" or c == "import" or c == "package":
            return statement(i)
        if c == "~":
            i += 1
        i = generic(i) if c == "<" else i
        if k[i] == "operator":
            return function_rest(type_(i + 1))
        if k[i] == "i" and k[i + 1] == "(":
            return function_rest(i + 1)
        if k[i] == "i" and k[i + 1] == "{" and language == "java":
            return block(i + 1)
        i = type_(i)
        if k[i] == "operator":
            i += 1
            while k[i] != "(":
                if k[i] == END:
                    fail(i, "'('")
                i += 1
            return function_rest(i)
        if k[i] == "this" and k[i + 1] == "[":
            i = accessors(listed(i + 2, "]", parameter))
            return i
        i = name(i)
        while k[i] == ".i":
            i += 1
        if k[i] in ("(", "<"):
            return function_rest(i)
        if k[i] in ("{", "=>") and language == "csharp":
            return accessors(i)
        return expect(declarators(i), ";")

    def accessors(i: int) -> int:
        if k[i] == "=>":
            return expect(expr(i + 1, 1), ";")
        i = expect(i, "{")
        while k[i] != "}":
            i = attributes(i)
            while k[i] in modifiers:
                i += 1
            i = name(i)
            i = block(i) if k[i] == "{" else expect(expr(i + 1, 1), ";") if k[i] == "=>" else expect(i, ";")
        i += 1
        return expect(expr(i + 1, 1), ";") if k[i] == "=" else i

    def impl(i: int) -> int:
        i = type_(generic(i + 1) if k[i + 1] == "<" else i + 1 + (k[i + 1] == "!"))
        if k[i] == "for":
            i = type_(i + 1)
        return members(expect(where(i), "{"), statement)

    def struct_rust(i: int) -> int:
        i = generic(name(i + 1))
        if k[i] == "(":
            i = listed(i + 1, ")", tuple_field)
            return expect(where(i), ";")
        i = where(i)
        return i + 1 if k[i] == ";" else listed(expect(i, "{"), "}", field_rust)

    def field_rust(i: int) -> int:
        return type_(expect(name(visible(attributes(i))), ":"))

    def tuple_field(i: int) -> int:
        return type_(visible(attributes(i)))

    def visible(i: int) -> int:
        if k[i] == "pub":
            i += 1
            if k[i] == "(":
                i = match.get(i, i) + 1
        return i

    def enum_rust(i: int) -> int:
        return listed(expect(where(generic(name(i + 1))), "{"), "}", variant)

    def variant(i: int) -> int:
        i = name(attributes(i))
        if k[i] == "(":
            i = listed(i + 1, ")", tuple_field)
        elif k[i] == "{":
            i = listed(i + 1, "}", field_rust)
        return expr(i + 1, 1) if k[i] == "=" else i

    def trait_rust(i: int) -> int:
        i = generic(name(i + 1))
        if k[i] == ":":
            i = type_(i + 1)
        return members(expect(where(i), "{"), statement)

    def use_rust(i: int) -> int:
        def tree(j: int) -> int:
            if k[j] == "{":
                return listed(j + 1, "}", tree)
            if k[j] == "*":
                return j + 1
            j = name(j) if k[j] != ".i" else j + 1
            while k[j] == ".i":
                j += 1
            if k[j] == "::":
                return tree(j + 1)
            return name(j + 1) if k[j] == "as" else j

        return expect(tree(i + 1), ";")

    def constant_rust(i: int) -> int:
        i = name(i + 1 + (k[i + 1] == "mut"))
        if k[i] == ":":
            i = type_(i + 1)
        return expect(expr(i + 1, 1) if k[i] == "=" else i, ";")

    def alias(i: int) -> int:
        if k[i + 1] not in ("i",) and k[i + 1] not in as_names:
            return ended(expr(i, 1))
        i = generic(name(i + 1))
        if k[i] == ":":
            i = type_(i + 1)
        i = where(i)
        if k[i] == "=":
            i = lines(i + 1)
            i = type_(i + (k[i] == "|"))
        return ended(i)

    def module_rust(i: int) -> int:
        i = name(i + 1)
        return i + 1 if k[i] == ";" else members(expect(i, "{"), statement)

    def macro_rules(i: int) -> int:
        return macro(name(i + 2))

    def path_statement(i: int) -> int:
        """package, import, using, namespace."""
        kind = k[i]
        i += 1
        while k[i] in ("static", "global"):
            i += 1
        if kind == "using" and k[i] in ("(", "var") or kind == "using" and declares(i) and k[i + 1] != "=":
            if k[i] == "(":
                return body(bracketed(i, lambda j: declarators(name(type_(j))) if declares(j) else expr(j, 1)))
            return expect(declarators(name(type_(i))), ";")
        if kind == "import" and language == "go":
            if k[i] == "(":
                return listed_lines(i + 1, import_go)
            return ended(import_go(i))
        i = type_(name(i) - 1) if language == "csharp" else name(i)
        if k[i] == "=" and language == "csharp":
            i = type_(i + 1)
        while k[i] in (".i", ".", "*", "_", "{", "[", "given"):
            if k[i] == "{":
                if language != "scala":
                    break
                i = match.get(i, n) 
            i += 1
        if k[i] == "as" or k[i] == "=>" and language == "scala":
            i = name(i + 1)
        while k[i] == "," and language == "scala":
            i = name(lines(i + 1))
            while k[i] == ".i":
                i += 1
        if k[i] == "{" and kind in ("namespace", "package"):
            return members(i + 1, member if type_first else statement)
        return ended(i)

    def import_go(i: int) -> int:
        if k[i] in ("i", ".", "_"):
            i += 1
        return expect(i, "s")

    def listed_lines(i: int, one: Callable[[int], int]) -> int:
        """Go's bracketed declarations (line ends inside round brackets are gone)."""
        while k[i] != ")":
            i = one(i)
            if k[i] == ";":
                i += 1
        return i + 1

    def import_js(i: int) -> int:
        j = i + 1
        if k[j] in ("(", ".i"):
            return ended(expr(i, 1))
        while k[j] in ("i", "{", ",", "*", "as", "type", "default", "async", "of") or k[j] in as_names and k[j] != "s":
            if k[j] == "{":
                j = listed(j + 1, "}", import_name)
            else:
                j += 1
        if k[j] == "=" and typed_js:
            return ended(expr(j + 1, 1))
        j = expect(j, "s")
        if k[j] == "with":
            j = expr(j + 1, 1)
        return ended(j)

    def import_name(i: int) -> int:
        while k[i] == "i" and k[i + 1] in ("i", "default", "as"):
            i += 1
        i = name(i)
        return name(i + 1) if k[i] in ("as", "i") and k[i] != "i" else i

    def export(i: int) -> int:
        i += 1
        if k[i] == "default":
            i += 1
            return statement(i) if k[i] in ("function", "class", "async") or k[i] in modifiers or k[i] == "@" or k[i] == "interface" else ended(expr(i, 1))
        if k[i] == "{" or k[i] == "*":
            if k[i] == "{":
                i = listed(i + 1, "}", import_name)
            else:
                i += 1
                if k[i] == "as" or k[i] == "i":
                    i = name(i + 1)
            if k[i] == "i":
                i = expect(i + 1, "s")
            return ended(i)
        if k[i] == "=":
            return ended(expr(i + 1, 1))
        if k[i] in STATEMENTS or k[i] in modifiers or k[i] == "@" or k[i] == "i" and (k[i + 1] == "i" or k[i + 1] in STATEMENTS):
            return statement(i)
        fail(i, "a declaration")

    def function_go(i: int) -> int:
        if k[i + 1] == "(" and k[match.get(i + 1, n) + 1] != "i":
            return ended(expr(i, 1))
        return function(i)

    def group_go(i: int) -> int:
        """var, const, type: one or several in brackets."""
        one = type_spec if k[i] == "type" else value_spec
        if k[i + 1] == "(":
            return listed_lines(i + 2, one)
        return ended(one(i + 1))

    def value_spec(i: int) -> int:
        i = name(i)
        while k[i] == ",":
            i = name(i + 1)
        if k[i] not in ("=", "\n", ";", ")", END, "i"):
            i = type_(i)
        elif k[i] == "i" and k[i + 1] in ("=", "\n", ".i", ";", END):
            i = type_(i)
        if k[i] == "=":
            i = argument(lines(i + 1))
            while k[i] == ",":
                i = argument(lines(i + 1))
        return i

    def type_spec(i: int) -> int:
        i = name(i)
        if k[i] == "[" and k[i + 1] == "i" and k[i + 2] != "]":
            i = generic(i)
        return type_(i + (k[i] == "="))

    def field_go(i: int) -> int:
        """Of a struct or interface: names and type, an embedded type, or a method."""
        if k[i] == "i" and k[i + 1] == "(":
            return function_rest(i + 1)
        if k[i] == "i" and k[i + 1] in (",", "i", "*", "[", "map", "func", "chan", "interface", "struct", "("):
            i += 1
            while k[i] == ",":
                i = name(i + 1)
        i = type_(i)
        while k[i] == "|":
            i = type_(i + 1)
        if k[i] == "s":
            i += 1
        return ended(i)

    def simple_go(i: int, one: Callable[[int], int]) -> int:
        """A simple statement: expressions, then an assignment or an operator of increment."""
        i = one(i)
        while k[i] == ",":
            i = one(lines(i + 1))
        if k[i] in ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="):
            i += 1
            if k[i] == "range":
                i += 1
            i = argument(lines(i)) if k[i] in ("[", "map") and one is expr1 else one(lines(i))
            while k[i] == ",":
                i = one(lines(i + 1))
        elif k[i] in ("++", "--"):
            i += 1
        elif k[i] == "<-":
            i = one(i + 1)
        return i

    def range_go(i: int) -> int:
        return header(i + 1) if k[i] == "range" else simple_go(i, header)

    def go_defer(i: int) -> int:
        return ended(expr(i + 1, 1))

    def new_(i: int) -> int:
        i += 1
        if k[i] == ".i":
            return i + 1
        if k[i] == "(" or k[i] == "{":
            return arguments(i) if k[i] == "(" else listed(i + 1, "}", element)
        if js:
            i = i + 1 if k[i] == "i" or k[i] in as_names else unary(i)
            while k[i] == ".i":
                i += 1
            if k[i] == "<" and typed_js:
                i = generic_call(i) or i
            return arguments(i) if k[i] == "(" else i
        i = attributes(i)
        if k[i] == "[":
            i = expect(i + 1, "]")
        else:
            i = name(i)
            while k[i] in (".i", "<", "?"):
                i = type_args(i + 1) if k[i] == "<" else i + 1
            if k[i] == "[" and language == "scala":
                i = listed(i + 1, "]", type_)
            sized = 0
            while k[i] == "[" and language != "scala":
                i = i + 2 if k[i + 1] == "]" else expect(expr(i + 1, 1), "]")
                sized += 1
            if sized:
                return listed(i + 1, "}", element) if k[i] == "{" else i
        if k[i] == "(":
            i = arguments(i)
        while k[i] == "with":
            i = type_(i + 1)
        if k[i] == "{" and not no_brace[0]:
            return listed(i + 1, "}", element) if language == "csharp" else members(i + 1, member)
        return i

    def function_expr(i: int) -> int:
        if k[i] == "async":
            if k[i + 1] == "function":
                return function(i + 1)
            return i + 1 if k[i + 1] != "i" and k[i + 1] != "(" else unary(i + 1)
        return function(i)

    def labelled(i: int) -> int:
        return statement(lines(i + 2))

    def simple_statement(i: int) -> int:
        """What begins with no keyword: an assignment, a call, a declaration of Java or C#."""
        if language == "go":
            return ended(simple_go(i, expr1))
        if type_first and declares(i):
            j = type_(i + (k[i] in ("final", "const", "ref")))
            j = name(j)
            if k[j] == "(" or k[j] == "<":
                return function_rest(j)
            return expect(declarators(j), ";")
        j = expr(i, 1)
        while k[j] == "," and js:
            j = expr(lines(j + 1), 1)
        if type_first and k[j - 1] not in (")", "++", "--", "]") and not assigns(i, j):
            fail(j, "a statement, not an expression")
        return ended(j)

    def assigns(i: int, j: int) -> bool:
        return any(x in precedence and precedence[x] == 1 for x in k[i:j]) or k[i] in ("++", "--", "await", "throw", "new")

    def statement(i: int) -> int:
        c = k[i]
        if c == "i":
            if k[i + 1] == ":" and language not in ("kotlin", "scala"):
                return labelled(i)
            d = k[i + 1]
            if d == "(" or d == ".i" or d == "=" :
                return simple_statement(i)
            contextual = CONTEXTUAL.get(language)
            if contextual and (d == "i" or d in keywords):
                return contextual(i)
            return simple_statement(i)
        handler = STATEMENTS.get(c)
        if handler:
            return handler(i)
        if c in modifiers or c == "@" or c == "#" and language == "rust" or c == "[" and language == "csharp":
            j = attributes(i)
            while k[j] in modifiers or k[j] == "i" and k[j + 1] in TYPES:
                if js and k[j + 1] in ("(", ".i", "=", "=>"):
                    return simple_statement(i)
                j += 1
                if k[j] == "(" and k[j - 1] in ("pub", "private", "protected"):
                    j = match.get(j, j) + 1
                if k[j] == "[" and k[j - 1] in ("private", "protected") and language == "scala":
                    j = match.get(j, j) + 1
                if k[j] == "s" and language == "rust":
                    j += 1
                j = lines(attributes(j)) if k[j] in ("@", "\n") else j
            if type_first:
                return member_typed(j)
            if j > i and k[j] != "@":
                if k[j] == "i" and k[j + 1] in ("class", "interface", "fun", "object", "i") or language == "rust" and k[j] == "i":
                    return statement(j + 1) if language == "kotlin" else statement(j)
                handler = STATEMENTS.get(k[j])
                if handler or k[j] == "{" and language in ("rust", "javascript"):
                    return (handler or block)(j)
                if language == "rust" and k[j - 1] in ("const", "static"):
                    return constant_rust(j - 1)
                if js:
                    return simple_statement(i)
            fail(j, "a declaration")
        if c == "{":
            return block(i) if not js or not (k[i + 1] in ("i", "s") and k[i + 2] in (":", ",")) else block(i)
        if c in CLOSE:
            fail(i, "a statement")
        return simple_statement(i)

    def typescript_word(i: int) -> int:
        """type, namespace, module, declare, abstract: words that aren't reserved."""
        if k[i + 2] in ("=", "<") and k[i + 1] == "i":
            return alias(i)
        if k[i + 1] == "i" and k[i + 2] in ("{", ".i"):
            j = i + 2
            while k[j] == ".i":
                j += 1
            return members(expect(j, "{"), statement)
        if k[i + 1] in STATEMENTS or k[i + 1] in modifiers:
            return statement(i + 1)
        return simple_statement(i)

    def kotlin_word(i: int) -> int:
        """Soft modifiers and keywords."""
        if k[i + 1] in STATEMENTS and k[i + 1] in ("class", "fun", "val", "var", "object", "interface"):
            return statement(i + 1)
        if k[i + 1] == "i" and k[i + 2] in ("class", "fun", "val", "var", "object", "interface", "i"):
            j = i
            while k[j] == "i" and k[j] not in STATEMENTS and k[j + 1] in ("i", "class", "fun", "val", "var", "object", "interface"):
                j += 1
            if k[j] in STATEMENTS:
                return statement(j)
        return simple_statement(i)

    def scala_word(i: int) -> int:
        if k[i + 1] in STATEMENTS and k[i + 1] in ("def", "class", "trait", "val"):
            return statement(i + 1)
        return simple_statement(i)

    def csharp_word(i: int) -> int:
        if k[i + 1] in TYPES:
            return statement(i + 1)
        if k[i + 1] == "i" and k[i + 2] == "(" and k[match.get(i + 2, n) + 1] in (";", ":"):
            j = match.get(i + 2, n) + 1
            if k[j] == ":" :
                return class_(i)
        return simple_statement(i)

    CONTEXTUAL = {"typescript": typescript_word, "tsx": typescript_word, "kotlin": kotlin_word, "scala": scala_word, "csharp": csharp_word, "java": csharp_word}
    TYPES = {"class", "interface", "enum", "struct", "trait", "object", "record"} & keywords
    jumps = {w: jump_statement for w in ("return", "break", "continue", "throw", "goto") if w in keywords}
    shared = {"if": if_, "for": for_, **jumps}
    STATEMENTS: dict[str, Callable[[int], int]] = dict(shared)
    PRIMARY: dict[str, Callable[[int], int]] = {}
    if "while" in keywords:
        STATEMENTS["while"] = while_
    if language == "rust":
        STATEMENTS |= {
            "let": variable_statement, "fn": function, "impl": impl, "struct": struct_rust, "enum": enum_rust, "trait": trait_rust,
            "use": use_rust, "const": lambda i: statement(i + 1) if k[i + 1] in ("fn", "unsafe", "async", "extern") else constant_rust(i),
            "static": constant_rust, "type": alias, "mod": module_rust, "loop": lambda i: block(i + 1),
            "match": lambda i: simple_or_block(i), "unsafe": lambda i: block(i + 1) if k[i + 1] == "{" else statement(i + 1),
            "pub": lambda i: statement(visible(i)), "async": lambda i: statement(i + 1),
            "extern": lambda i: ended(name(i + 2)) if k[i + 1] == "crate" else statement(i + 1 + (k[i + 1] == "s")),
        }
        STATEMENTS["if"] = STATEMENTS["loop"] = STATEMENTS["match"] = lambda i: simple_or_block(i)
        PRIMARY |= {"if": if_, "match": match_, "loop": lambda i: block(i + 1), "unsafe": lambda i: block(i + 1), "while": while_, "for": for_, **{w: jump for w in jumps}}
    elif language == "go":
        del STATEMENTS["break"]
        STATEMENTS |= {
            "break": jump_statement, "func": function_go, "var": group_go, "const": group_go, "type": group_go, "import": path_statement,
            "package": path_statement, "switch": switch_, "select": select_, "go": go_defer, "defer": go_defer, "fallthrough": lambda i: ended(i + 1),
        }
        PRIMARY |= {"func": lambda i: block(func_type(i))}
        def func_type(i: int) -> int:
            i = parameters(i + 1)
            return i if k[i] == "{" else type_(i)

        def composite(i: int) -> int:
            i = type_(i)
            return listed(i + 1, "}", element) if k[i] == "{" else arguments(i) if k[i] == "(" else i

        PRIMARY |= {"map": composite, "struct": composite, "chan": composite, "interface": composite}
    elif js:
        STATEMENTS |= {
            "var": variable_statement, "let": variable_statement, "const": lambda i: statement(i + 1) if k[i + 1] == "enum" else variable_statement(i),
            "function": function, "async": lambda i: function(i + 1) if k[i + 1] == "function" else simple_statement(i), "class": class_,
            "switch": switch_, "try": try_, "do": do_, "import": import_js, "export": export, "debugger": lambda i: ended(i + 1),
        }
        PRIMARY |= {"function": function, "async": function_expr, "class": class_, "new": new_, "import": lambda i: i + 1}
        if typed_js:
            STATEMENTS |= {"interface": class_, "enum": class_}
    elif type_first:
        STATEMENTS |= {
            "switch": switch_, "try": try_, "do": do_, "import": path_statement, "package": path_statement, "class": class_, "interface": class_,
            "enum": class_, "synchronized": lambda i: block(bracketed(i + 1, expr1)), "lock": lambda i: body(bracketed(i + 1, expr1)),
            "assert": lambda i: ended(expr(i + 1, 1) if k[expr(i + 1, 1)] != ":" else expr(expr(i + 1, 1) + 1, 1)),
            "namespace": path_statement, "using": path_statement, "struct": class_, "delegate": member_typed,
            "record": lambda i: class_(i) if k[i + 1] in ("i", "class", "struct") else simple_statement(i),
            "foreach": lambda i: body(bracketed(i + 1, lambda j: expr(expect(name(type_(j)), "in"), 1))),
            "unsafe": lambda i: block(i + 1) if k[i + 1] == "{" else member_typed(i), "checked": lambda i: block(i + 1), "void": member_typed,
            "const": lambda i: simple_statement(i) if language == "csharp" else fail(i, "a statement"),
            "fixed": lambda i: body(bracketed(i + 1, lambda j: declarators(name(type_(j))))),
        }
        STATEMENTS = {w: f for w, f in STATEMENTS.items() if w in keywords}
        PRIMARY |= {
            "new": new_, "throw": lambda i: expr(i + 1, 1), "typeof": lambda i: bracketed(i + 1, type_), "sizeof": lambda i: bracketed(i + 1, type_),
            "switch": lambda i: block_cases(expect(bracketed(i + 1, expr1), "{")), "delegate": lambda i: block(parameters(i + 1) if k[i + 1] == "(" else i + 1),
            "default": lambda i: arguments(i + 1) if k[i + 1] == "(" else i + 1, "async": lambda i: unary(i + 1),
        }
    else:
        STATEMENTS |= {
            "try": lambda i: simple_statement(i), "do": do_, "import": path_statement, "package": path_statement, "class": class_, "object": class_,
            "val": variable_statement, "var": variable_statement,
        }
        if language == "kotlin":
            STATEMENTS |= {"fun": function, "interface": class_, "typealias": alias}
            STATEMENTS["if"] = lambda i: simple_statement(i)
            PRIMARY |= {
                "if": if_, "try": try_, "when": when_, "fun": function, "object": class_, **{w: jump for w in jumps}, "[": lambda i: listed(i + 1, "]", expr1),
                "while": while_, "for": for_,
            }
        else:
            STATEMENTS |= {"def": function, "trait": class_, "type": alias, "given": lambda i: statement_given(i), "enum": class_, "case": case_or_statement}
            STATEMENTS["if"] = lambda i: simple_statement(i)
            STATEMENTS["for"] = lambda i: simple_statement(i)
            PRIMARY |= {"if": if_, "try": try_, "for": for_, "new": new_, "while": while_, **{w: jump for w in jumps}}

    def statement_given(i: int) -> int:
        while k[i] not in ("{", "=", "with", "\n", END):
            i = match.get(i, i) + 1
        return expr(i + 1, 1) if k[i] == "=" else members(i + 1 + (k[i] == "with"), statement) if k[i] in ("{", "with") else i

    def simple_or_block(i: int) -> int:
        """Rust: if, match, loop as a statement, or as the beginning of an expression."""
        j = PRIMARY[k[i]](i)
        if k[j] in (".i", "?"):
            j = expr_more(unary_rest(j), 1)
            return ended(j)
        return j + 1 if k[j] == ";" else j

    def unary_rest(i: int) -> int:
        while k[i] in (".i", "?", "("):
            i = arguments(i) if k[i] == "(" else i + 1
        return i

    DECLARATIONS = set(STATEMENTS)
    ternary_like = {"?", "\n", "switch", "with", "match", "!", "i", "{"}
    continuing = {"&&", "||", "?:", "??", "?", "+", "*", "/", "|", "as", "==", "!="} & (set(precedence) | {"?"})
    if js or language in ("kotlin", "scala"):
        continuing -= {"*", "/"} if not js else set()
    simple_follow = set(precedence) | _STOP | {"?", ":"}
    simple_follow -= {"<", "(", "[", "{", "?", "::"} | postfix
    if language in ("kotlin", "scala"):
        simple_follow.discard(":")

    def top(i: int) -> int:
        i = lines(i)
        while k[i] == ";":
            i = lines(i + 1)
        if k[i] == END:
            return i
        if type_first and language == "java":
            handler = STATEMENTS.get(k[i]) if k[i] in ("import", "package", "class", "interface", "enum") else None
            return handler(i) if handler else member_typed(i)
        if language == "go" and k[i] not in ("func", "var", "const", "type", "import", "package"):
            fail(i, "a declaration")
        if language == "rust" and k[i] not in STATEMENTS and k[i] not in ("#", "pub") and not (k[i] == "i" and k[i + 1] in ("!", "::", ".i", "i")):
            fail(i, "an item")
        if language == "rust" and k[i] in ("let", "if", "while", "for", "match", "return", "loop"):
            fail(i, "an item")
        if language == "rust" and k[i] == "i" and k[i + 1] == "!" and k[i + 2] == "i":
            return macro_rules(i)
        return statement(i)

    i = 0
    while k[i] != END:
        try:
            i = guarded(top, i, False)
        except Unexpected as e:
            errors.append((e.at, e.message))
            break
    return errors
