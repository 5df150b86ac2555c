"""Text, path and comment expressions, all evaluated inside the JVM."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

# File name extension to language.
LANGUAGE_OF = {
    "rs": "rust", "py": "python", "js": "javascript", "cjs": "javascript", "mjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "cs": "csharp", "fs": "fsharp", "fsx": "fsharp",
    "scala": "scala", "sc": "scala", "hs": "haskell", "rb": "ruby", "kt": "kotlin", "kts": "kotlin",
}

# Globs that a listing leaves out unless others are configured.
DEFAULT_EXCLUDES = [
    "**/target/**", "**/node_modules/**", "**/dist/**", "**/out/**", "**/.next/**", "**/.nuxt/**", "**/__pycache__/**",
    ".venv/**", "venv/**", "env/**", "vendor/**", "dist-newstyle/**", ".stack-work/**", ".bundle/**", ".gradle/**",
    "**/build/**", ".sbt/**", "**/bin/Debug/**", "**/bin/Release/**", "**/obj/**",
]


def lines(text: Column) -> Column:
    """Lines without their ends (LF or CRLF); a final line end opens no further line, and an empty text has no lines.

    Java's ``$`` also matches before a final line end, so the end is anchored with ``\\z``.
    """
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    )


def window_starts(all_lines: Column, size: int) -> Column:
    """First line of each window of ``size`` lines; windows don't overlap."""
    if size < 1:
        raise ValueError("windows need at least one line")
    return F.when(F.size(all_lines) > 0, F.sequence(F.lit(0), F.size(all_lines) - 1, F.lit(size)))


def preview(content: Column, count: int = 3) -> Column:
    """The first lines, each indented by two spaces."""
    shown = F.transform(F.slice(lines(content), 1, count), lambda x: F.concat(F.lit("  "), x))
    return F.array_join(shown, "\n")


def strip_xml_tags(text: Column) -> Column:
    """Drop tags line by line; an unclosed tag takes the rest of its line, a stray ``>`` goes alone; blank lines go."""
    kept = F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"<[^>]*(>|$)|>", "")))
    return F.array_join(F.filter(kept, lambda x: x != ""), "\n")


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends (``F.trim`` takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def strip_line_markers(comment: Column, language: Column) -> Column:
    """A line comment without its marker, and without tags in C#.

    The marker is chosen once, from the beginning of the comment; lines that begin otherwise keep what they have.
    """
    whole = trim(comment)
    marker = (
        F.when(language.isin("rust", "csharp", "fsharp") & whole.startswith("///"), "///")
        .when(language.isin("python", "ruby"), "#")
        .when((language == "haskell") & whole.startswith("-- |"), "-- |")
        .when(language == "haskell", "--")
        .otherwise("//")
    )

    def bare(line: Column) -> Column:
        line = trim(line)
        return trim(F.when(line.startswith(marker), line.substr(F.length(marker) + 1, F.length(line))).otherwise(line))

    text = F.array_join(F.transform(F.split(whole, "\n", -1), bare), "\n")
    return F.when(language == "csharp", strip_xml_tags(text)).otherwise(text)


def strip_block_markers(comment: Column) -> Column:
    """A block comment without its marks and the asterisk that leads each line; blank lines go."""
    whole = trim(comment)
    inner = F.when(whole.startswith("/**"), whole.substr(F.lit(4), F.length(whole))).otherwise(whole.substr(F.lit(3), F.length(whole)))
    inner = F.when(inner.endswith("*/"), inner.substr(F.lit(1), F.length(inner) - 2)).otherwise(inner)
    bare = F.transform(F.split(inner, "\n", -1), lambda x: trim(F.regexp_replace(trim(x), r"^\*", "")))
    return F.array_join(F.filter(bare, lambda x: x != ""), "\n")


def dedent(text: Column) -> Column:
    """Trim the first line and take the smallest indentation of the others' non-blank lines off them; trim the whole."""
    parts = F.split(text, "\n", -1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    solid = F.filter(rest, lambda x: F.trim(x) != "")
    indent = F.coalesce(F.array_min(F.transform(solid, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    cut = F.transform(rest, lambda x: F.when(F.trim(x) == "", "").otherwise(x.substr(indent + 1, F.length(x))))
    return trim(F.array_join(F.concat(F.array(F.trim(parts[0])), cut), "\n"))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, in its own case; null for none and for a name that begins with it."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), F.lit(""))


def language_of(path: Column) -> Column:
    """Language by extension, or null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.element_at(table, F.coalesce(extension(path), F.lit("")))


def glob_regex(glob: str) -> str | None:
    """A regular expression for a glob: ``*`` and ``?`` cross ``/``, ``**/`` stands for any number of directories.

    A glob that can't be read is reported and ignored (None).
    """
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while glob.startswith("*", i):
                i += 1
            out += ".*"
            continue
        if c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                warnings.warn(f"glob {glob!r} is malformed and ignored", stacklevel=2)
                return None
            inner = glob[i + 1 : end]
            negated = inner[0] in "!^"
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]^])", r"\\\1", inner[negated:]) + "]"
            i = end + 1
            continue
        out += "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs; false for no glob."""
    patterns = [p for p in map(glob_regex, globs) if p]
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(p)
    return out


def in_hidden_directory(path: Column) -> Column:
    """Whether a directory on the path begins with a dot; the file's own name may."""
    return path.rlike(r"(?:^|/)\.[^/]+/")


def listed(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a listing keeps a path: included (or, without includes, of a known extension), not excluded, not hidden."""
    kept = matches_any(path, include) if include else extension(path).isin(*LANGUAGE_OF)
    return F.coalesce(kept & ~matches_any(path, exclude or []) & ~in_hidden_directory(path), F.lit(False))
