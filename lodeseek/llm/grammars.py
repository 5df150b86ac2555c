"""Packrat grammars for each language: they know comments, strings, brackets or indentation, and the heads of functions
and types. Their actions emit each function with its offsets in the source and the documentation that belongs to it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from lodeseek.llm.nesting import room_for
from lodeseek.llm.peg import Parser, Rule, State, action, between, choice, many, optional, seq, skip, token, unless


@dataclass
class Found:
    """A function in a text: its name, its documentation or None, and its offsets."""

    name: str
    doc: str | None
    start: int
    end: int


def _strip_block(raw: str) -> str:
    body = re.sub(r"^/\*+!?|^\{-+ ?\|?|\*+/$|-\}$", "", raw.strip())
    return "\n".join(re.sub(r"^\s*\*+ ?", "", line) for line in body.split("\n"))


def _strip_line(raw: str) -> str:
    return re.sub(r"^\s*(?:///?!?|#+|--+ ?[|^]?)\s?", "", raw)


class _Comments:
    """The comments directly above a function, as the reference takes them: line by line, an ordinary one cuts off."""

    def __init__(self, doc_mark: str):
        self.is_doc = re.compile(doc_mark).match
        self.parts: list[str] = []

    def add(self, raw: str):
        if self.is_doc(raw):
            self.parts.append(_strip_block(raw) if raw.startswith(("/*", "{-")) else _strip_line(raw))
        else:
            self.parts.clear()

    def take(self) -> str | None:
        doc = "\n".join(self.parts).strip()
        self.parts.clear()
        return doc or None


#: What the reference takes for documentation, by the beginning of a comment.
_DOC_MARK = {
    "rust": r"///(?!/)|/\*\*(?!/)", "csharp": r"///|/\*\*(?!/)", "fsharp": r"///|/\*\*(?!/)", "java": r"/\*\*(?!/)",
    "javascript": r"/\*\*(?!/)", "typescript": r"/\*\*(?!/)", "tsx": r"/\*\*(?!/)", "scala": r"/\*\*(?!/)", "kotlin": r"/\*\*(?!/)",
    "haskell": r"-- ?[|^]|\{- ?\|", "go": r"", "ruby": r"", "python": r"",
}
_STRINGS = r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^\n][^'\n]{0,8})'|`(?:[^`\\]|\\[\s\S])*`"
# Brackets that hold neither strings nor comments, and brackets one deep at most: passed over as one token.
_SMALL = r"\((?:[^(){}\[\]\"'`/]++|\([^(){}\[\]\"'`/]*+\))*+\)|\[[^(){}\[\]\"'`/]*+\]"
_PY_SMALL = r"\((?:[^(){}\[\]\"'#]++|\([^(){}\[\]\"'#]*+\))*+\)|\[[^(){}\[\]\"'#]*+\]"
_JS_STRINGS = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"

def _events(value: object) -> Iterator[tuple]:
    """The marked values in a tree of lists, in order."""
    left = [value]
    while left:
        value = left.pop()
        if isinstance(value, tuple):
            if value and isinstance(value[0], str):
                yield value
        elif isinstance(value, list):
            left.extend(reversed(value))


def _from_events(value: object, language: str) -> list[Found]:
    comments = _Comments(_DOC_MARK[language])
    found = []
    for event in _events(value):
        if event[0] == "comment":
            comments.add(event[1])
        elif event[0] == "function":
            found.append(Found(event[1], comments.take(), event[2], event[3]))
        elif event[0] in ("blank", "other"):
            comments.parts.clear()
    return found


# Words that a call or a statement may begin with where a method could stand.
_NOT_NAMES = (
    "if for while switch catch return throw else do try new await typeof case super this when match loop using lock foreach synchronized yield"
)
_MODIFIERS = (
    "public private protected internal static final abstract override open async export default virtual sealed suspend inline operator infix "
    "tailrec external synchronized native strictfp unsafe extern partial new readonly implicit lazy const declare accessor get set"
)
_TYPE_WORDS = {
    "rust": "impl trait mod", "java": "class interface enum record @interface", "csharp": "class interface struct enum record namespace",
    "javascript": "class", "typescript": "class namespace module", "kotlin": "class interface object", "scala": "class trait object enum package",
    "go": "", "haskell": "", "fsharp": "",
}
_TYPE_WORDS["tsx"] = _TYPE_WORDS["typescript"]


def _words(words: str) -> str:
    return rf"(?:{'|'.join(map(re.escape, words.split()))})\b"


def _named(value: object, start: int, end: int) -> tuple:
    """A function's event: the name that its head marked, and its offsets."""
    return ("function", next(e[1] for e in _events(value) if e[0] == "name"), start, end)


def _brace_grammar(language: str) -> Parser:
    """The grammar of a language with braces (and of Haskell and F# rows, which hold one declaration each).

    text     <- item*                 item <- gap / remark / type / function / other
    type     <- prefix type-word ... "{" item* "}"
    function <- prefix head rest      prefix <- (attribute / modifier)*
    head     <- what the language writes: "fn" name generics? params; type name params; name (":" type)? "=" arrow; ...
    params   <- "(" (string / comment / block / plain)* ")"
    generics <- "<" (string / generics / block / plain)* ">"

    Functions in functions stay in their bodies.
    """
    js, ts = language in ("javascript", "typescript", "tsx"), language in ("typescript", "tsx")
    by_line = language in ("scala", "kotlin")
    string = token(_JS_STRINGS if js else _STRINGS)
    comment = choice(token(r"//[^\n]*"), between("/*", "*/")) if language != "haskell" else choice(token(r"--+[^\n]*"), between("{-", "-}"))
    loose = r"[/'`\"]"  # a mark that opens neither a comment nor a string
    unit, block, generics, type_ = Rule(), Rule(), Rule(), Rule()

    def stretch(but: str) -> Parser:
        """Text without ``but``, with the strings, line comments and small brackets in it, as one token."""
        remark = "" if language == "haskell" else r"|//[^\n]*+"
        return token(rf"(?:[^{{}}()\[\]\"'`/{but}]++|{_SMALL}|{_JS_STRINGS if js else _STRINGS}{remark})++")

    def enclosed(left: str, right: str) -> Parser:
        return skip(seq(token(left), many(unit), token(rf"{right}|\Z")))

    round_, square, curly = enclosed(r"\(", r"\)"), enclosed(r"\[", r"\]"), enclosed(r"\{", r"\}")
    block.define(choice(curly, round_, square))
    unit.define(choice(stretch(""), comment, block, token(loose)))
    generics.define(
        skip(seq(token("<"), many(choice(token(r"(?:[^<>{}()\[\];\"'`=-]|[=-]>?)+"), string, generics, block, token("'"))), token(">")))
    )
    params = seq(token(r"\s*"), round_)
    name = action(token(r"#?[\w$]+" if js else r"\w+"), lambda m, a, b: ("name", m.group()))
    _ = skip(many(choice(token(r"\s+"), comment)))

    # Types, as far as heads need them.
    path = token(r"[\w$]+(?:\s*\??\.\s*[\w$]+)*")
    suffix = skip(many(choice(token(r"\?(?!\.)|\*"), seq(token(r"\s*"), square))))
    if ts:
        arrow = seq(_, token("=>"), _, type_)
        operand = choice(string, curly, seq(round_, optional(arrow)), seq(square, suffix), token(r"-?\d[\w.]*"),
                         seq(token(_words("keyof typeof readonly unique infer new asserts abstract") + r"\s*"), type_),
                         seq(path, optional(seq(token(r"\s*"), generics)), suffix))
        joined = seq(_, token(r"[|&]|is\b|extends\b|\?(?!\.)|:"), _, operand)
        type_.define(skip(seq(optional(token(r"[|&]\s*")), operand, many(joined))))
    else:
        type_.define(skip(seq(choice(round_, seq(path, optional(seq(token(r"\s*"), generics)))), suffix)))

    # What may stand before a head.
    if language == "rust":
        attribute = seq(token(r"#!?"), square)
        modifier = choice(seq(token("pub"), optional(round_)), seq(token(r"extern\s*"), optional(string)), token(_words("default const async unsafe")))
    elif language in ("csharp", "fsharp"):
        attribute = seq(token(r"(?=\[[\w<])"), square)
        modifier = token(_words(_MODIFIERS) + r"(?=[\s*#\[\"]|\w*\*)")
    else:
        attribute = seq(token(r"@(?!interface\b)[\w.:$]+"), optional(generics), optional(round_))
        modifier = seq(token(_words(_MODIFIERS) + r"(?=[\s*#\[\"]|\w*\*)"), optional(square) if by_line else _)
    mods = Rule()  # memoised from each of them on, as heads are tried again and again
    one_mod = skip(choice(seq(attribute, _), seq(modifier, _)))
    mods.define(choice(seq(one_mod, mods), token("")))
    some_mods = seq(one_mod, mods)
    no_name = unless(token(_words(_NOT_NAMES)))
    opens = token(r"\s*(?=\{)")

    # The rest of a head within its statement: memoised from each place on, as it is tried from each place.
    head_rest = Rule()
    piece = choice(string, comment, round_, square, generics, token(r"[^{}()\[\];\"'`<=]+|<"))
    head_rest.define(choice(seq(skip(piece), head_rest), token("")))

    def up_to(ends: str) -> Parser:
        """Anything within a statement up to one of the marks, which stays."""
        return seq(skip(head_rest), token(rf"(?={ends})"))

    if language == "rust":
        head = seq(mods, token(r"fn\s+"), name)
    elif language == "java":
        method = seq(mods, optional(seq(generics, _)), type_, token(r"\s+"), _, no_name, name, params, up_to(r"[{;]"))
        head = choice(method, seq(some_mods, no_name, name, params, up_to(r"\{")))
    elif language == "csharp":
        named = seq(no_name, many(seq(token(r"\w+"), optional(generics), token(r"\."))), name, optional(generics), params, up_to(r"\{|;|=>"))
        head = choice(seq(mods, type_, token(r"\s+"), _, named), seq(some_mods, named))
    elif language == "go":
        head = seq(token(r"func\s*"), optional(seq(round_, token(r"\s*"))), name)
    elif js:
        returns = optional(seq(_, token(":"), _, type_)) if ts else _
        method = seq(mods, token(r"(?:function\b\s*\*?\s*|\*\s*)?"), no_name, name, token(r"\??\s*"), optional(generics), params, returns,
                     token(r"\s*(?=[{;])") if ts else opens)
        value = seq(optional(seq(token(r"async\b"), _)), choice(
            seq(choice(seq(optional(generics), round_, returns), token(r"[\w$]+")), _, token("=>"), _), seq(token(r"function\b\s*\*?\s*(?:[\w$]+)?"), params, returns)))
        field = seq(mods, token(r"(?:(?:const|let|var)\b\s*)?"), no_name, name, token(r"[?!]?"), returns, _, token(r"=(?![=>])"), _, value)
        head = choice(method, field)
    elif language == "kotlin":
        receiver = many(seq(token(r"\w+"), optional(generics), token(r"\??\.")))
        quoted = action(token(r"`[^`\n]+`"), lambda m, a, b: ("name", m.group()))
        head = seq(mods, token(r"fun\s+"), optional(seq(generics, _)), receiver, choice(quoted, name), token(r"\s*(?=\()"))
    elif language == "scala":
        head = seq(mods, token(r"def\s+"), action(token(r"[^\s(\[:=]+"), lambda m, a, b: ("name", m.group())))
    elif language == "fsharp":
        quoted = action(token(r"``[^`\n]+``|[\w']+"), lambda m, a, b: ("name", m.group()))
        head = seq(mods, token(_words("let member override default") + r"|static\s+member\b"), token(r"\s+(?:(?:rec|inline|private|internal|mutable)\s+)*(?:\w+\.)?"), quoted)
    else:
        head = action(token(r"[a-z_][\w']*"), lambda m, a, b: ("name", m.group()))

    # What follows a head: a body in braces, an expression, or the end of a declaration without one.
    ended = token(r"[^\n;{}]*;") if language not in ("scala", "kotlin", "rust") else token(r"(?!)")
    tail = skip(many(choice(stretch(r";\n"), comment, round_, square, token(loose))))
    if by_line:  # a body may be an expression behind "=", which may begin on the next line
        line = skip(many(choice(stretch(r"\n"), comment, block, token(loose))))
        rest = seq(line, optional(seq(token(r"(?<==)[ \t]*\n\s*"), line)))
    else:
        rest = seq(tail, choice(curly, token(r";|\n|\Z"), ended))
    function = action(seq(no_name, head, skip(rest)), _named)

    gap = action(token(r"[ \t\r]*\n(?P<blank>(?:[ \t\r]*\n)+)?|[ \t\r]+|;|,"), lambda m, a, b: ("blank",) if m.group("blank") else ("space",))
    remark = action(comment, lambda m, a, b: ("comment", m[0]))
    inner = Rule()
    item = [gap, remark]
    if _TYPE_WORDS[language]:
        plain = token(r"[^{}()\[\];\"'`<\n]+" if by_line else r"[^{}()\[\];\"'`<]+")
        type_head = skip(seq(mods, token(r"(?:(?:enum|annotation|data|inner|fun|companion|case|abstract|value|ref)\s+)*" + _words(_TYPE_WORDS[language])),
                             many(choice(plain, generics, string, comment, round_, square, token("<")))))
        item.append(seq(type_head, token(r"\{"), inner, token(r"\}|\Z")))
    item.append(function)
    item.append(action(choice(string, skip(block), token(r"[^{}()\[\]\"'`/\s;,]+|[/'`\"]|[)\]]")), lambda v, a, b: ("other",)))
    inner.define(many(choice(*item)))
    return seq(inner, skip(token(r"[\s\S]*")))


_PY_STRING = (
    r"[A-Za-z]{0,2}(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
)


def _python_grammar() -> Parser:
    """Lines: decorator / function head with an optional docstring / type head / comment / blank / statement."""
    brackets = Rule()
    piece = choice(token(rf"(?:[^()\[\]{{}}\"'#\n]++|{_PY_SMALL}|{_PY_STRING}|#[^\n]*+)++"), brackets, token(r"[\"']"))
    inside = choice(piece, token(r"\n"))
    brackets.define(choice(*(skip(seq(token(a), many(inside), token(rf"{b}|\Z"))) for a, b in ((r"\(", r"\)"), (r"\[", r"\]"), (r"\{", r"\}")))))
    to_end = seq(many(piece), token(r"\n|\Z"))
    docstring = action(
        seq(token(r"[ \t]*(?:#[^\n]*)?\n(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*|[ \t]*"), token(_PY_STRING), token(r"[ \t]*(?:#[^\n]*)?(?=\n|;|\Z)")),
        lambda v, a, b: v[1].group(),
    )
    until_colon = many(choice(brackets, token(_PY_STRING), token(r"[^()\[\]{}\"'#\n:]+")))
    function = action(
        seq(token(r"(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+)"), until_colon, token(r":"), optional(docstring), to_end),
        lambda v, a, b: ("function", v[0].group("name"), len(v[0].group("indent").expandtabs()), v[3], a, b),
    )
    type_head = action(seq(token(r"(?P<indent>[ \t]*)class[ \t]+\w+"), until_colon, token(r":"), optional(docstring), to_end),
                       lambda v, a, b: ("type", len(v[0].group("indent").expandtabs())))
    decorator = action(seq(token(r"[ \t]*@"), to_end), lambda v, a, b: ("decorator",))
    comment = action(token(r"[ \t]*(#[^\n]*)(?:\n|\Z)"), lambda m, a, b: ("comment", m.group(1)))
    blank = action(token(r"[ \t\r]*\n"), lambda m, a, b: ("blank",))
    statement = action(seq(token(r"(?P<indent>[ \t]*)(?=\S)"), to_end), lambda v, a, b: ("other", len(v[0].group("indent").expandtabs())))
    line = Rule()
    line.define(choice(decorator, function, type_head, comment, blank, statement, token(r"[^\n]*\n|[^\n]+")))
    return many(line)


def _clean_docstring(raw: str | None) -> str | None:
    if raw is None:
        return None
    body = re.sub(r"^[A-Za-z]{0,2}(\"\"\"|'''|\"|')|(\"\"\"|'''|\"|')$", "", raw)
    return body.strip() or None


def _from_python(value: object) -> list[Found]:
    """Functions at the top or in a class; those within functions are left out."""
    comments = _Comments("")
    found: list[Found] = []
    levels: list[tuple[int, str]] = []  # the open definitions by indentation
    for event in _events(value):
        if event[0] == "comment":
            comments.add(event[1])
            continue
        if event[0] == "blank":
            comments.parts.clear()
            continue
        if event[0] == "decorator":
            continue
        indent = event[2] if event[0] == "function" else event[1]
        while levels and levels[-1][0] >= indent:
            levels.pop()
        if event[0] == "function":
            above = comments.take()
            if all(kind == "type" for _, kind in levels):
                found.append(Found(event[1], _clean_docstring(event[3]) or above, event[4], event[5]))
            levels.append((indent, "function"))
        else:
            comments.parts.clear()
            if event[0] == "type":
                levels.append((indent, "type"))
    return found


def _ruby_grammar() -> Parser:
    """Lines: def / type head / other openers of ``end`` / end / comment / blank."""
    string = r"\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'"
    rest = seq(many(choice(token(string), token(r"[^\"'#\n]+|[\"']"), token(r"#\{[^}\n]*\}|#[^\n]*"))), token(r"\n|\Z"))
    function = action(seq(token(r"[ \t]*def[ \t]+(?:self\.|\w+\.)?(?P<name>[^\s(;=]+[?!=]?)(?P<short>[ \t]*(?:\([^)\n]*\))?[ \t]*=(?![=~])[^\n]*|[^\n]*\bend\b[ \t]*(?=\n|\Z))?"), rest),
                      lambda v, a, b: ("function", v[0].group("name"), bool(v[0].group("short")), a, b))
    type_head = action(seq(token(r"(?![^\n]*\bend\b[ \t]*(?:\n|\Z))[ \t]*(?:class|module)\b"), rest), lambda v, a, b: ("type",))
    one_line = r"(?![^\n]*\bend\b[ \t]*(?:#[^\n]*)?(?:\n|\Z))"
    opener = action(seq(token(one_line + r"(?:[ \t]*(?:if|unless|while|until|for|case|begin)\b|[^\n#\"']*?(?:=|\|\||&&|return)[ \t]*(?:if|unless|case|begin|while)\b)"), rest), lambda v, a, b: ("open",))
    do_line = action(seq(token(one_line + r"[^\n#\"']*(?:(?:\"[^\"\n]*\"|'[^'\n]*')[^\n#\"']*)*\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*(?=\n|#|\Z)"), rest), lambda v, a, b: ("open",))
    end = action(seq(token(r"[ \t]*end\b"), rest), lambda v, a, b: ("end",))
    comment = action(token(r"[ \t]*(#[^\n]*)(?:\n|\Z)"), lambda m, a, b: ("comment", m.group(1)))
    blank = action(token(r"[ \t\r]*\n"), lambda m, a, b: ("blank",))
    line = Rule()
    line.define(choice(comment, blank, function, type_head, opener, end, do_line, action(rest, lambda v, a, b: ("other",))))
    return many(line)


def _from_ruby(value: object) -> list[Found]:
    comments = _Comments("")
    found: list[Found] = []
    levels: list[str] = []
    for event in _events(value):
        kind = event[0]
        if kind == "comment":
            comments.add(event[1])
            continue
        if kind == "function":
            above = comments.take()
            if "function" not in levels:
                found.append(Found(event[1], above, event[3], event[4]))
            if not event[2]:
                levels.append("function")
        elif kind in ("type", "open"):
            levels.append(kind)
        elif kind == "end" and levels:
            levels.pop()
        comments.parts.clear()
    return found


_GRAMMARS: dict[str, Parser] = {}


def functions_in(language: str, text: str) -> list[Found]:
    """The functions and methods of a text (at the top or in a type) with their documentation; [] without a grammar."""
    if language not in _GRAMMARS:
        if language == "python":
            _GRAMMARS[language] = _python_grammar()
        elif language == "ruby":
            _GRAMMARS[language] = _ruby_grammar()
        elif language in _TYPE_WORDS:
            _GRAMMARS[language] = _brace_grammar(language)
        else:
            return []
    with room_for(text):
        got = _GRAMMARS[language](State(text), 0)
        if got is None:
            return []
        if language == "python":
            return _from_python(got[1])
        return _from_ruby(got[1]) if language == "ruby" else _from_events(got[1], language)
