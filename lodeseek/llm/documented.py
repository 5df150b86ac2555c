"""Problem 5: functions and methods paired with their documentation, by packrat grammars for each language.

The grammars (``grammars``) emit each function with its offsets and the documentation that the reference's rules give it.
Whether the documentation says something is decided here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.grammars import functions_in

# -- informative documentation --------------------------------------------------------------------------------------

# Words that don't count.
_STOP = set(
    "function method the a an this that is of to in on at by for from with into onto over under as about after before "
    "between through during without within upon per via against among toward towards than off out up down "
    "der die das den dem des ein eine einen einem einer eines von zu zum zur mit im in am an auf aus bei nach vor für "
    "le la les un une des du de dans par pour sur avec sans sous vers chez "
    "el los las una unos unas del al en con por para sin sobre hasta desde entre".split()
)
_PLACEHOLDER = re.compile(
    r"(?:todo|fixme|xxx|tbd|tba|hack|wip|n/?a|none|nothing|placeholder|undocumented|stub)\b.*"
    r"|(?:no|missing|needs|insert|add|write|empty) (?:a )?(?:description|documentation|docs?|comment|summary|docstring)\b.*"
    r"|(?:description|documentation|docs?|comment|summary)(?: text)? (?:goes|to follow|follows|missing|pending|needed|will|here|comes?|to be|is missing)\b.*"
    r"|see (?:above|below|also|there)\b.{0,20}|auto-?generated\b.*|to be (?:written|done|documented|added|completed)\b.*"
    r"|(?:not|not yet|un)\s?documented\b.*|\{?@?inheritdoc\}?.*",
    re.IGNORECASE,
)
_LICENCE = re.compile(
    r"(?:copyright\b|\(c\)|©|spdx-|licen[sc]ed? (?:under|to)\b|all rights reserved|(?:mit|apache|bsd|gpl|lgpl|mpl) licen[sc]e\b|see (?:the )?licen[sc]e\b).*",
    re.IGNORECASE,
)
_DIRECTIVE = re.compile(
    r"(?:eslint|tslint|jshint|jslint|noinspection|ts-(?:ignore|nocheck|expect-error|check)|rubocop|pylint|flake8|noqa|mypy|pyright|type:\s*ignore|"
    r"clang-format|clang-tidy|nolint|nosonar|nosec|prettier-ignore|istanbul|c8 ignore|v8 ignore|coverage|pragma|go:\w+|rustfmt|clippy|checkstyle|"
    r"suppress\w*|swiftlint|ktlint|detekt|resharper|scalastyle|scalafmt|hlint|fantomas|yapf|fmt|isort|black)\b[:\s-]?.*",
    re.IGNORECASE,
)
_WORD = re.compile(r"[^\W_]+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def name_words(name: str) -> set[str]:
    return {w.lower() for w in _NAME_PART.findall(name)} | {name.lower()}


def informative(doc: str | None, name: str, least: int = 4) -> bool:
    """Whether ``least`` words are left without tag lines, place-holders, licence notices, directives, words of the
    function's name, "function", "method", articles and prepositions."""
    if not doc:
        return False
    own = name_words(name)
    left = 0
    for line in re.sub(r"<[^<>\n]*>", " ", doc).split("\n"):
        line = line.strip().strip("*#/-=~|!{}\"' \t").strip()
        if not line or line.startswith(("@", "\\param", ":param", ":return")):
            continue
        if _PLACEHOLDER.match(line) or _LICENCE.match(line) or _DIRECTIVE.match(line):
            continue
        left += sum(1 for w in _WORD.findall(line) if w.lower() not in _STOP and w.lower() not in own and not w.isdigit())
    return left >= least


# -- rows -----------------------------------------------------------------------------------------------------------

# Node kinds of the rows that are functions themselves.
FUNCTION_KINDS = {
    "function_definition", "function_declaration", "function_item", "function", "method", "method_declaration", "method_definition",
    "value_declaration", "generator_function_declaration", "arrow_function", "singleton_method", "constructor_declaration",
    "secondary_constructor", "local_function_statement", "lexical_declaration",
}
_CLASS_START = re.compile(r"(?:@[^\n]*\n\s*)*(?:export\s+|abstract\s+|public\s+)*(?:class|module|impl|trait|interface)\b")

PAIRS = "file_path string, language string, func_name string, doc string, start_line int, end_line int, code string"


def _pairs_of(parts: list[tuple]) -> list[tuple]:
    """All functions, documented or not, of rows that may be parts of one definition, cut at a number of lines."""
    path, language, symbol, _, start, kind, summary = parts[0]
    content = "\n".join(p[3] for p in parts)
    is_function = kind in FUNCTION_KINDS or kind == "decorated_definition" and not _CLASS_START.match(content)
    found = functions_in(language, content) if language else []
    if is_function:
        if len(parts) > 1 and len(found) > 1:  # not one function that was cut, but several next to each other
            return [pair for part in parts for pair in _pairs_of([part])]
        name = found[0].name if found else symbol
        if symbol and language in ("haskell", "fsharp"):
            name = symbol
        doc = summary if summary and summary.strip() else found[0].doc if found and language == "python" else None
        return [(path, language, name, doc, start, start + content.count("\n"), content)] if name else []
    out = []
    for f in found:
        line = start + content.count("\n", 0, f.start)
        code = content[f.start : f.end].rstrip("\n")
        out.append((path, language, f.name, f.doc, line, line + code.strip("\n").count("\n"), code))
    return out


def pair_functions(parsed: DataFrame) -> DataFrame:
    """Every function and method of ``parsed`` (parsed chunks) with its documentation.

    Columns: file_path, language, func_name, doc (null if there is none), start_line, end_line (0-based, of the file),
    code. Rows with a null path, content or language are left out; a null start line counts as 0, a null symbol as empty;
    repeated rows count once. A definition that was cut into several rows is put together again before it is parsed:
    rows of the same symbol, kind and summary whose lines follow each other, all of the first one's number of lines but
    for a shorter last one. An empty summary is none. Only
    file_path, language, symbol, content, start_line, end_line, node_kind and summary are read.
    """
    key = ["file_path", "language", "start_line", "end_line", "symbol", "node_kind", "summary", "content"]
    rows = parsed.where(F.col("file_path").isNotNull() & F.col("content").isNotNull() & F.col("language").isNotNull())
    rows = rows.select(
        "file_path",
        "language",
        F.coalesce("start_line", F.lit(0)).alias("start_line"),
        F.coalesce("end_line", F.lit(0)).alias("end_line"),
        F.coalesce("symbol", F.lit("")).alias("symbol"),
        "node_kind",
        "summary",
        "content",
    )
    rows = rows.distinct().repartition("file_path").sortWithinPartitions(*key)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in PAIRS.split(", ")]
        held: list[tuple] = []
        size = last_size = last_end = -1
        for batch in batches:
            out: list[tuple] = []
            for path, language, start, end, symbol, kind, summary, content in zip(*(batch[c] for c in key)):
                own = end - start + 1
                same = held and (path, language, symbol, kind, summary) == (*held[0][:3], *held[0][5:])
                if same and start == last_end + 1 and last_size == size and own <= size:
                    held.append((path, language, symbol, content, start, kind, summary))
                else:
                    if held:
                        out += _pairs_of(held)
                    held, size = [(path, language, symbol, content, start, kind, summary)], own
                last_end, last_size = end, own
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(_pairs_of(held), columns=names)

    return rows.mapInPandas(stream, PAIRS)


def documented_functions(parsed: DataFrame) -> DataFrame:
    """The pairs whose documentation says something."""

    @F.pandas_udf("boolean")
    def says_something(docs: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([informative(d, n) for d, n in zip(docs, names)], dtype=bool)

    pairs = pair_functions(parsed).where(F.col("doc").isNotNull())
    return pairs.where(says_something("doc", "func_name"))
