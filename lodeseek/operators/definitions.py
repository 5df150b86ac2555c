"""Finding the definitions in a source text, with their names and documentation.

A text is scanned once: comments and strings are blanked out, brackets are matched. Then it is walked from definition to
definition. Whatever isn't one (a namespace, a condition, a call with a function among its arguments) is looked into;
a definition is not. Nothing recurses, so nesting costs no stack.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

# The kinds of definitions that get a summary, by language.
SUMMARISED = {
    "rust": {"function_item", "impl_item", "trait_item", "struct_item", "enum_item"},
    "python": {"function_definition", "class_definition", "decorated_definition"},
    "javascript": {"function_declaration", "class_declaration", "method_definition", "arrow_function", "generator_function_declaration"},
    "typescript": {
        "function_declaration", "class_declaration", "method_definition", "arrow_function", "generator_function_declaration",
        "interface_declaration",
    },
    "java": {"method_declaration", "class_declaration", "interface_declaration", "constructor_declaration"},
    "csharp": {"method_declaration", "class_declaration", "interface_declaration", "constructor_declaration", "property_declaration"},
    "go": {"function_declaration", "method_declaration"},
    "scala": {"function_definition", "class_definition", "trait_definition", "given_definition", "extension_definition"},
    "haskell": {"function", "class", "instance_decl"},
    "ruby": {"method", "class", "module", "singleton_method", "singleton_class"},
    "fsharp": {"value_declaration", "type_defn"},
    "kotlin": {"function_declaration", "class_declaration", "object_declaration", "secondary_constructor"},
}
SUMMARISED["tsx"] = SUMMARISED["typescript"]

# How a documentation comment begins; in the other languages any comment above a definition is one.
DOC_MARKS = {
    "rust": ("///", "/**"), "csharp": ("///", "/**"), "fsharp": ("///", "/**"), "java": ("/**",), "javascript": ("/**",),
    "typescript": ("/**",), "tsx": ("/**",), "scala": ("/**",), "kotlin": ("/**",), "haskell": ("-- |", "{-|"),
}

# -- what is blanked out --------------------------------------------------------------------------------------------

_C = r"(?P<comment>//[^\n]*|/\*)"
_TEXT = r"\"(?:[^\"\\\n]|\\[\s\S])*\""
_BLOCK_TEXT = r"\"\"\"[\s\S]*?\"\"\"(?!\")"
_LETTER = r"(?<![\w'])'(?:[^'\\\n]|\\[^\n']+|\\')'"
_JS_TEXT = r"\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
_JS_PATTERN = r"(?:(?<=[(,=:\[!&|?{};])|(?<=[(,=:\[!&|?{};] )|(?<=return ))/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*"
_QUIET = {
    "rust": rf"{_C}|r(?P<fence>#*)\"[\s\S]*?\"(?P=fence)|\"(?:[^\"\\]|\\[\s\S])*\"|{_LETTER}",
    "java": rf"{_C}|{_BLOCK_TEXT}|{_TEXT}|{_LETTER}",
    "csharp": rf"{_C}|{_BLOCK_TEXT}|\$?@\$?\"(?:[^\"]|\"\")*\"|{_TEXT}|{_LETTER}",
    "go": rf"{_C}|`[^`]*`|{_TEXT}|{_LETTER}",
    "javascript": rf"{_C}|{_JS_TEXT}|{_JS_PATTERN}",
    "kotlin": rf"{_C}|{_BLOCK_TEXT}|{_TEXT}|{_LETTER}",
    "scala": rf"{_C}|{_BLOCK_TEXT}|{_TEXT}|{_LETTER}",
    "fsharp": rf"(?P<comment>//[^\n]*|/\*|\(\*(?!\)))|{_BLOCK_TEXT}|@\"(?:[^\"]|\"\")*\"|\"(?:[^\"\\]|\\[\s\S])*\"|{_LETTER}",
    "haskell": rf"(?P<comment>--+(?![!#$%&*+./<=>?@\\^|~-])[^\n]*|\{{-(?!#))|\{{-#[\s\S]*?#-\}}|\"(?:[^\"\\]|\\[\s\S])*\"|{_LETTER}",
    "python": r"(?P<comment>#[^\n]*)|\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'",
    "ruby": r"(?P<comment>(?<![\w)\]\"'#$])#(?!\{)[^\n]*|^=begin\b)|\"(?:[^\"\\]|\\[\s\S])*\"|(?<![\w)\]$?])'(?:[^'\\]|\\[\s\S])*'",
}
_QUIET["typescript"] = _QUIET["tsx"] = _QUIET["javascript"]
_QUIET = {name: re.compile(pattern, re.MULTILINE) for name, pattern in _QUIET.items()}
_BLOCKS = {"/*": re.compile(r"/\*|(\*/)"), "(*": re.compile(r"\(\*|(\*\))"), "{-": re.compile(r"\{-|(-\})"), "=begin": re.compile(r"(?m)(?!)|(^=end\b[^\n]*)")}
_NESTED_COMMENTS = {"rust", "kotlin", "scala", "haskell", "fsharp"}


class Scanned:
    """A text with blanks in place of comments and of what strings hold, its comments, and the partner of each bracket."""

    def __init__(self, language: str, text: str):
        self.text = text
        self.comments: dict[int, int] = {}  # start to end
        parts, at, pos = [], 0, 0
        search = _QUIET[language].search
        while m := search(text, pos):
            start, pos = m.span()
            if m["comment"] is not None:
                opener = next((b for b in _BLOCKS if m["comment"].startswith(b)), None)
                if opener:
                    pos = _block_end(text, start + len(opener), _BLOCKS[opener], language in _NESTED_COMMENTS)
                self.comments[start] = pos
                parts += [text[at:start], _blanks(text[start:pos])]
            else:
                parts += [text[at:start], '"', _blanks(text[start + 1 : pos])]
            at = pos
        self.quiet = "".join([*parts, text[at:]])
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.quiet):
            if m.group() in "({[":
                stack.append(m.start())
            elif stack and self.quiet[stack[-1]] + m.group() in ("()", "[]", "{}"):
                self.partner[stack.pop()] = m.start()
            elif m.group() == "}":  # a round or square bracket was left open
                while stack and self.quiet[stack[-1]] != "{":
                    stack.pop()
                if stack:
                    self.partner[stack.pop()] = m.start()
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, at: int) -> int:
        return bisect_right(self.line_starts, at) - 1

    def column(self, at: int) -> int:
        """Indentation of a place: its column if only blanks stand before it, else that of its line's first token."""
        start = self.line_starts[self.line(at)]
        return len(re.compile(r"[ \t]*").match(self.quiet, start, at).group().expandtabs())


def _blanks(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _block_end(text: str, at: int, marks: re.Pattern, nested: bool) -> int:
    depth = 1
    for m in marks.finditer(text, at):
        depth += -1 if m[1] is not None else nested
        if not depth:
            return m.end()
    return len(text)


# -- heads ----------------------------------------------------------------------------------------------------------

_MODIFIERS = (
    r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|unsafe|extern|partial|readonly|new|data|inner|inline|"
    r"value|annotation|enum(?=\s+class)|fun(?=\s+interface)|suspend|operator|infix|tailrec|external|expect|actual|const|lateinit|case|implicit|lazy|opaque|"
    r"transparent|non-sealed|strictfp|synchronized|native|default|ref|file|required)(?:\[\w+\])?\s+)"
)
_MARK = r"(?:@(?!interface\b)[\w.:]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?\s*)"
_MODS = f"{_MODIFIERS}*+"  # possessive: what may stand before a head is never tried in parts
_MARKED = f"(?:{_MARK}|{_MODIFIERS})*+"
_GENERIC = r"<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>"
_TYPE = rf"[\w.]+(?:\s*{_GENERIC})?(?:\s*\[[\s,]*\])*\??"
_NOT_TYPES = r"(?!(?:return|throw|new|else|await|yield|using|package|import|goto|case|assert|delete|in|is|as|var)\b)"
_OPEN_ROUND = r"\s*(?=\()"

#: Heads at the beginning of a statement, in the order in which they are tried: kind and pattern with the name.
HEADS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        (kind, r"(?:pub(?:\s*\([^)]*\))?\s+)?" + pattern)
        for kind, pattern in [
            ("function_item", r"(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)"),
            ("impl_item", rf"(?:default\s+)?(?:unsafe\s+)?impl\b(?:\s*{_GENERIC})?\s*!?(?P<name>\w+(?=\s*(?:\{{|for\b|where\b)))?"),
            ("struct_item", r"struct\s+(?P<name>\w+)"), ("enum_item", r"enum\s+(?P<name>\w+)"), ("union_item", r"union\s+(?P<name>\w+)(?=\s*[<{])"),
            ("trait_item", r"(?:unsafe\s+)?(?:auto\s+)?trait\s+(?P<name>\w+)"), ("type_item", r"type\s+(?P<name>\w+)"),
            ("const_item", r"const\s+(?P<name>\w+)\s*:"), ("static_item", r"static\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
            ("mod_item", r"(?:unsafe\s+)?mod\s+(?P<name>\w+)"), ("macro_definition", r"macro_rules!\s*(?P<name>\w+)"),
        ]
    ],
    "java": [
        (kind, _MARKED + pattern)
        for kind, pattern in [
            ("class_declaration", r"class\s+(?P<name>\w+)"), ("annotation_type_declaration", r"@interface\s+(?P<name>\w+)"),
            ("interface_declaration", r"interface\s+(?P<name>\w+)"), ("enum_declaration", r"enum\s+(?P<name>\w+)"),
            ("record_declaration", r"record\s+(?P<name>\w+)(?=\s*[(<])"),
            ("method_declaration", rf"(?:{_GENERIC}\s*)?{_NOT_TYPES}{_TYPE}\s+(?P<name>\w+){_OPEN_ROUND}"),
        ]
    ],
    "csharp": [
        (kind, r"(?:\[[^\]]*\]\s*)*" + _MODS + pattern)
        for kind, pattern in [
            ("record_declaration", r"record\s+(?:(?:class|struct)\s+)?(?P<name>\w+)"), ("class_declaration", r"class\s+(?P<name>\w+)"),
            ("interface_declaration", r"interface\s+(?P<name>\w+)"), ("struct_declaration", r"struct\s+(?P<name>\w+)"),
            ("enum_declaration", r"enum\s+(?P<name>\w+)"), ("delegate_declaration", rf"delegate\s+{_TYPE}\s+(?P<name>\w+)"),
        ]
    ],
    "go": [
        ("function_declaration", r"func\s+(?P<name>\w+)"), ("method_declaration", r"func\s*\([^)]*\)\s*(?P<name>\w+)"),
        ("type_declaration", r"type\b\s*(?:(?P<name>\w+)|(?=\())"), ("const_declaration", r"const\b\s*(?:(?P<name>\w+)|(?=\())"),
        ("var_declaration", r"var\b\s*(?:(?P<name>\w+)|(?=\())"),
    ],
    "javascript": [
        ("generator_function_declaration", r"(?:async\s+)?function\s*\*\s*(?P<name>[\w$]+)"),
        ("function_declaration", r"(?:async\s+)?function\b\s*(?P<name>[\w$]*)"),
        ("class_declaration", r"(?:abstract\s+)?class\b\s*(?P<name>(?!extends\b|implements\b)[\w$]*)"),
    ],
    "kotlin": [
        (kind, _MARKED + pattern)
        for kind, pattern in [
            ("companion_object", r"companion\s+object\b\s*(?P<name>\w*)"), ("class_declaration", r"(?:class|interface)\s+(?P<name>\w+)"),
            ("object_declaration", r"object\s+(?P<name>\w+)"), ("type_alias", r"typealias\s+(?P<name>\w+)"),
            ("function_declaration", rf"fun\s+(?:{_GENERIC}\s*)?(?:[\w.]+(?:{_GENERIC})?\??\.)?(?P<name>\w+|`[^`\n]+`){_OPEN_ROUND}"),
            ("property_declaration", rf"va[lr]\s+(?:{_GENERIC}\s*)?(?:[\w.]+(?:{_GENERIC})?\??\.)?(?P<name>\w+|`[^`\n]+`)"),
        ]
    ],
    "scala": [
        (kind, _MARKED + pattern)
        for kind, pattern in [
            ("function_definition", r"def\s+(?P<name>[^\s(\[:={]+)"), ("class_definition", r"class\s+(?P<name>\w+)"),
            ("object_definition", r"(?:package\s+)?object\s+(?P<name>\w+)"), ("trait_definition", r"trait\s+(?P<name>\w+)"),
            ("enum_definition", r"enum\s+(?P<name>\w+)"), ("given_definition", r"given\s+(?P<name>\w+(?=\s*[:\[(]))?"),
            ("extension_definition", r"extension\s*(?=[(\[])(?P<name>)"), ("type_definition", r"type\s+(?P<name>\w+)"),
        ]
    ],
    "python": [
        ("decorated_definition", r"@[^\n]*\n(?:[ \t]*(?:@[^\n]*)?\n)*[ \t]*(?:async\s+)?(?:def|class)\s+(?P<name>\w+)"),
        ("function_definition", r"(?:async\s+)?def\s+(?P<name>\w+)"), ("class_definition", r"class\s+(?P<name>\w+)"),
    ],
    "ruby": [
        ("singleton_method", r"def\s+(?:self|\w+)\.(?P<name>[^\s(;=]+[?!=]?)"), ("method", r"def\s+(?P<name>[^\s(;=]+[?!=]?)"),
        ("singleton_class", r"class\s*<<\s*(?P<name>)"), ("class", r"class\s+(?P<name>[\w:]+)"), ("module", r"module\s+(?P<name>[\w:]+)"),
    ],
    "haskell": [
        ("type_family", r"(?:type|data)\s+(?:family|instance)\s+(?P<name>\w+)"), ("data_type", r"data\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"),
        ("newtype", r"newtype\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"), ("class", r"class\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"),
        ("instance_decl", r"instance\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"), ("type_synonym", r"type\s+(?P<name>\w+)"),
        ("function", r"(?!(?:import|module|infix[lr]?|deriving|default|foreign|where|pattern)\b)(?P<name>[a-z_][\w']*)(?![\w', ]*::)"),
    ],
    "fsharp": [
        ("value_declaration", r"(?:\[<[^\n]*>\]\s*)*let\s+(?:(?:rec|inline|private|internal|public|mutable)\s+)*(?P<name>``[^`\n]+``|[\w']+)"),
        ("type_defn", r"(?:\[<[^\n]*>\]\s*)*type\s+(?:(?:private|internal|public)\s+)?(?P<name>[\w']+)"),
        ("module_defn", r"(?:\[<[^\n]*>\]\s*)*module\s+(?:(?:rec|private|internal|public)\s+)*(?P<name>\w+)(?=\s*=)"),
        ("exception_definition", r"exception\s+(?P<name>\w+)"), ("namespace", r"namespace\s+(?:rec\s+)?(?P<name>)[\w.]+"),
    ],
}
HEADS["typescript"] = [
    *HEADS["javascript"],
    ("interface_declaration", r"interface\s+(?P<name>[\w$]+)"), ("enum_declaration", r"(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
    ("type_alias_declaration", rf"type\s+(?P<name>[\w$]+)(?=\s*(?:{_GENERIC}\s*)?=)"),
]
HEADS["tsx"] = HEADS["typescript"]
_JS = {"javascript", "typescript", "tsx"}
#: Words before a head that belong to the statement around the definition.
_BEFORE = {name: re.compile(r"(?:(?:export|default|declare)\s+|@[\w.]+(?:\s*\((?:[^()]|\([^()]*\))*\))?\s*)+") for name in _JS}
_HEADS = {name: [(kind, re.compile(pattern)) for kind, pattern in heads] for name, heads in HEADS.items()}
#: What a head can begin with: all other places are passed without trying.
_MAY_BEGIN = re.compile(r"[\w@\[$`*#]")

# Functions among other code, in JavaScript and its kin: named by what they are given to.
_ARROW = re.compile(r"(?:async\s*)?(?:(?P<single>[\w$]+)\s*=>|(?=[(<]))")
_GIVEN = re.compile(r"(?:(?:export\s+)?(?:const|let|var)\s+)?(?P<name>[\w$.#]+)\s*(?::[^=;{}()]*|:\s*\([^()]*\)\s*=>[^=;{}()]*)?\s*(?:=(?![=>])|:)\s*")
_METHOD = re.compile(
    rf"(?:(?:static|async|get|set|public|private|protected|override|readonly)\s+)*\*?\s*(?!(?:if|for|while|switch|catch|with|function|return|await|new|super)\b)(?P<name>#?[\w$]+)\s*(?:{_GENERIC})?(?=\()"
)


@dataclass
class Definition:
    """A definition: offsets in the text, and lines from 0, both ends included."""

    kind: str
    symbol: str
    start: int
    end: int
    first: int
    last: int
    summary: str | None


class _Walk:
    def __init__(self, language: str, text: str):
        self.language = language
        self.s = Scanned(language, text)
        self.found: list[Definition] = []

    # Where a definition ends.

    def extent(self, start: int, behind: int, kind: str) -> int:
        if self.language == "ruby":
            return self.to_end_word(start)
        if kind == "namespace":
            following = re.compile(r"^namespace\b", re.MULTILINE).search(self.s.quiet, behind)
            return self.trimmed(following.start() if following else len(self.s.quiet))
        if self.language in ("python", "haskell", "fsharp", "kotlin", "scala") or kind in ("type_declaration", "const_declaration", "var_declaration", "type_alias_declaration"):
            return self.by_lines(start, behind)
        return self.by_braces(behind)

    def by_braces(self, at: int) -> int:
        """Behind the first block in braces, or the first semicolon; an arrow's body goes on to the semicolon."""
        quiet, partner = self.s.quiet, self.s.partner
        while m := re.compile(r"[({\[;]|=>|\}").search(quiet, at):
            at = m.start()
            if m.group() in "({[":
                close = partner.get(at)
                if close is None:
                    return self.trimmed(len(quiet))
                if m.group() == "{":
                    return self.with_semicolon(close + 1)
                at = close + 1
            elif m.group() == ";":
                return at + 1
            elif m.group() == "}":
                return self.trimmed(at)
            else:
                at += 2
        return self.trimmed(len(quiet))

    def with_semicolon(self, at: int) -> int:
        m = re.compile(r"[ \t]*;").match(self.s.quiet, at)
        return m.end() if m and self.language == "rust" else at

    def by_lines(self, start: int, behind: int) -> int:
        """Behind the last line that belongs to a statement: lines within brackets, deeper lines, and those that go on."""
        s, quiet = self.s, self.s.quiet
        indent, at = s.column(start), behind
        goes_on = _GOES_ON[self.language]
        while True:
            at = self.line_end(at)
            m = _NEXT_LINE.match(quiet, at)
            if not m or not m["code"]:
                return self.trimmed(at)
            place = m.end() - 1
            if s.column(place) <= indent and not goes_on.match(quiet, place):
                return self.trimmed(at)
            at = place

    def line_end(self, at: int) -> int:
        """The end of a place's line, or of the line on which the last bracket opened there is closed."""
        quiet, partner = self.s.quiet, self.s.partner
        while m := _LINE_END.search(quiet, at):
            if m.group() == "\n":
                return m.start()
            if m.group() in ")}]":  # what surrounds the statement ends here
                return m.start()
            at = partner.get(m.start(), m.start()) + 1
        return len(quiet)

    def to_end_word(self, start: int) -> int:
        s = self.s
        no = s.line(start)
        until = s.line_starts[no + 1] - 1 if no + 1 < len(s.line_starts) else len(s.quiet)
        line = s.quiet[start:until]
        if re.search(r"\bend\s*$", line) or re.match(r"def\b[^=(]*(?:\([^)]*\))?\s*=(?!=)", line):
            return self.trimmed(until)
        end = re.compile(rf"^[ \t]{{{len(self.indent_text(start))}}}end\b", re.MULTILINE).search(s.quiet, until)
        return end.end() if end else self.trimmed(len(s.quiet))

    def indent_text(self, at: int) -> str:
        return re.compile(r"[ \t]*").match(self.s.text, self.s.line_starts[self.s.line(at)]).group()

    def trimmed(self, at: int) -> int:
        """``at`` without blanks and comments before it."""
        while at and self.s.quiet[at - 1].isspace():
            at -= 1
        return at

    # The walk.

    def run(self) -> list[Definition]:
        s, quiet, language = self.s, self.s.quiet, self.language
        heads, before = _HEADS[language], _BEFORE.get(language)
        closing: list[int] = []  # brackets that are being looked into
        docs: list[str] = []
        above: list[str] = []  # the documentation above the statement that is being looked into
        at, begins, n = 0, True, len(quiet)
        statement = 0
        while at < n:
            if closing and at >= closing[-1]:
                at, begins = max(at, closing.pop() + 1), True
                docs.clear()
                continue
            if at in s.comments:
                at = self.note(at, docs)
                continue
            c = quiet[at]
            if c.isspace():
                if c == "\n":
                    begins = begins or language not in _JS or not _CONTINUED.search(quiet, max(0, at - 40), at)
                at += 1
                continue
            if c in ";,":
                at, begins = at + 1, True
                continue
            m = None
            if begins:
                statement = at
            if begins and _MAY_BEGIN.match(c):
                place = before.match(quiet, at).end() if before and before.match(quiet, at) else at
                kind, m = next(((k, m) for k, h in heads if (m := h.match(quiet, place))), ("", None))
                if m and language in ("java", "csharp") and kind == "method_declaration" and not self.has_body(m.end()):
                    m = None
                if m:
                    if language == "haskell" and kind == "function" and (closing or s.column(place)):
                        m = None
                    else:
                        at = self.add(kind, m["name"] or "", at, self.extent(at, m.end(), kind), docs)
                        begins = True
                        continue
                if language in _JS and closing and (m := _METHOD.match(quiet, at)) and self.has_body(m.end()):
                    at = self.add("method_definition", m["name"], at, self.by_braces(m.end()), docs)
                    begins = True
                    continue
                if language == "kotlin" and closing and re.compile(r"constructor\s*\(").match(quiet, at):
                    at = self.add("secondary_constructor", "", at, self.by_lines(at, at), docs)
                    begins = True
                    continue
            if begins and not (language == "haskell" and not closing):  # something else stands below the documentation
                above = docs[:]
                docs.clear()
            if language in _JS and (c.isalnum() or c in "_$(<") and (end := self.arrow(at)):
                given = _GIVEN.fullmatch(quiet, statement, at)
                at = self.add("arrow_function", given["name"].split(".")[-1] if given else "", at, end, above if given else [])
                begins = False
                continue
            if language == "haskell" and begins and not closing and s.column(at) == 0:  # a signature parts nothing
                end = self.by_lines(at, at)
                if "::" not in quiet[at:end]:
                    docs.clear()
                at, begins = max(end, at + 1), True
                continue
            if c in "({[" and at in s.partner:
                closing.append(s.partner[at])
                at, begins = at + 1, True
                docs.clear()
                continue
            at, begins = max(at + 1, _TOKEN.match(quiet, at).end()), False
        return self.found

    def note(self, at: int, docs: list[str]) -> int:
        """Take a comment in, or let it part what follows from the documentation above; returns where it ends."""
        s, end = self.s, self.s.comments[at]
        if self.language == "haskell" and s.text.startswith("-- |", at):  # goes on over the lines below
            while m := re.compile(r"\n[ \t]*(?=--)").match(s.text, end):
                if s.text.startswith("-- |", m.end()) or m.end() not in s.comments:
                    break
                end = s.comments[m.end()]
        raw = s.text[at:end]
        marks = DOC_MARKS.get(self.language)
        if marks is None or raw.startswith(marks):
            docs.append(strip_markers(raw, self.language))
        else:
            docs.clear()
        return end

    def has_body(self, at: int) -> bool:
        """Whether the round brackets that open at a place are followed by a block, with a type or the like between."""
        m = re.compile(r"\s*").match(self.s.quiet, at)
        close = self.s.partner.get(m.end())
        return close is not None and re.compile(r"[^;{}()=]*\{").match(self.s.quiet, close + 1) is not None

    def arrow(self, at: int) -> int | None:
        """Where the arrow function that begins at a place ends; None if there is none."""
        s, quiet = self.s, self.s.quiet
        m = _ARROW.match(quiet, at)
        if not m or at and (quiet[at - 1].isalnum() or quiet[at - 1] in "_$."):
            return None
        behind = m.end()
        if not m["single"]:
            g = re.compile(rf"{_GENERIC}\s*").match(quiet, behind)
            behind = g.end() if g else behind
            close = s.partner.get(behind)
            if close is None or quiet[behind] != "(":
                return None
            m = re.compile(r"\s*(?::[^=;{}()]*(?:\{[^{}]*\}[^=;{}()]*)?)?\s*=>").match(quiet, close + 1)
            if not m:
                return None
            behind = m.end()
        body = re.compile(r"\s*").match(quiet, behind).end()
        if body < len(quiet) and quiet[body] == "{" and body in s.partner:
            return s.partner[body] + 1
        return self.expression_end(at, body)

    def expression_end(self, start: int, at: int) -> int:
        """Where an expression without a block ends: a comma, a semicolon, a closing bracket, or a line that goes no deeper."""
        s, quiet = self.s, self.s.quiet
        indent = s.column(start)
        while m := re.compile(r"[({\[]|[)}\],;]|\n\s*").search(quiet, at):
            c = m.group()[0]
            if c in "({[":
                at = s.partner.get(m.start(), m.start()) + 1
            elif c != "\n":
                return self.trimmed(m.start())
            elif m.end() >= len(quiet) or s.column(m.end()) <= indent and quiet[m.end()] not in ".?:)&|+":
                return self.trimmed(m.start())
            else:
                at = m.end()
        return self.trimmed(len(quiet))

    def add(self, kind: str, symbol: str, start: int, end: int, docs: list[str]) -> int:
        s = self.s
        end = max(end, start + 1)
        summary = None
        if kind in SUMMARISED[self.language]:
            summary = self.docstring(start, end) if self.language == "python" else None
            summary = summary or "\n".join(docs).strip() or None
        self.found.append(Definition(kind, symbol, start, end, s.line(start), s.line(end - 1), summary))
        docs.clear()
        return end

    def docstring(self, start: int, end: int) -> str | None:
        """The string that is the first statement of a Python definition's body."""
        s = self.s
        head = re.compile(r"(?:async\s+)?(?:def|class)\b").search(s.quiet, start, end)
        at = head.end() if head else start
        while m := re.compile(r"[({\[:]").search(s.quiet, at, end):
            if m.group() != ":":
                at = s.partner.get(m.start(), m.start()) + 1
                continue
            body = re.compile(r"\s*").match(s.quiet, m.end(), end).end()
            literal = _PY_LITERAL.match(s.text, body, end)
            return dedent(literal.group(2)) or None if literal else None
        return None


_NEXT_LINE = re.compile(r"(?:[ \t\r]*\n)+[ \t]*(?P<code>[^\s])|\s*\Z")
_LINE_END = re.compile(r"[\n(){}\[\]]")
_TOKEN = re.compile(r"[\w$]+|[^\w\s]")
_CONTINUED = re.compile(r"(?:[=+\-*/%&|?:,.(\[]|=>)\s*\Z")
_PY_LITERAL = re.compile(r"(\"\"\"|'''|\"|')((?:[^\\]|\\[\s\S])*?)\1")
_GOES_ON = {
    "python": re.compile(r"[)\]}]"), "haskell": re.compile(r"[)\]}]|where\b|then\b|else\b|of\b"), "fsharp": re.compile(r"[)\]}|]|with\b|and\b|then\b|else\b|\|>"),
    "kotlin": re.compile(r"[)\]}.?:={]|else\b|&&|\|\|"), "scala": re.compile(r"[)\]}.={]|else\b|with\b|extends\b|yield\b|catch\b|finally\b|end\b"),
    "go": re.compile(r"[)\]}]"), "typescript": re.compile(r"[)\]}|&.?:={]"),
}
_GOES_ON["tsx"] = _GOES_ON["javascript"] = _GOES_ON["typescript"]


def strip_markers(raw: str, language: str) -> str:
    """A comment without its markers: one kind of marker for all lines of a comment; a block comment's blank lines go."""
    raw = raw.strip()
    if raw.startswith("/*"):
        inner = raw.removeprefix("/**") if raw.startswith("/**") else raw.removeprefix("/*")
        bare = (line.strip().removeprefix("*").strip() for line in inner.removesuffix("*/").split("\n"))
        return "\n".join(line for line in bare if line)
    marker = next(mark for mark in LINE_MARKERS.get(language, ("//",)) if raw.startswith(mark) or mark == LINE_MARKERS.get(language, ("//",))[-1])
    text = "\n".join(line.strip().removeprefix(marker).strip() for line in raw.split("\n"))
    if language == "csharp":
        bare = (re.sub(r"<[^>]*(?:>|$)|>", "", line).strip() for line in text.split("\n"))
        text = "\n".join(line for line in bare if line)
    return text


# Markers of line comments, the longer ones first; the others have "//".
LINE_MARKERS = {
    "rust": ("///", "//"), "csharp": ("///", "//"), "fsharp": ("///", "//"), "python": ("#",), "ruby": ("#",), "haskell": ("-- |", "--"),
}


def dedent(text: str) -> str:
    """Trim the first line, take the smallest indentation of the others' solid lines off them, trim the whole."""
    first, *rest = text.split("\n")
    indent = min((len(x) - len(x.lstrip()) for x in rest if x.strip()), default=0)
    return "\n".join([first.strip(), *(x[indent:] if x.strip() else "" for x in rest)]).strip()


def definitions(language: str, text: str) -> list[Definition]:
    """The definitions of a text in order, none within another; [] for a language without heads. Line ends are LF."""
    return _Walk(language, text).run() if language in HEADS else []
