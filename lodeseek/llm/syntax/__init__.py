"""Syntax checkers: for each language a tokenizer and a recursive-descent grammar with panic-mode recovery.

Every checker is a function from a text to the list of its errors, each (line, message), the first cause first.
"""

from __future__ import annotations

from collections.abc import Callable

from lodeseek.llm.syntax import braces, layout, python, ruby

CHECKERS: dict[str, Callable[[str], list[tuple[int, str]]]] = {
    **{name: braces.checker(name) for name in braces.LANGUAGES},
    "python": python.check,
    "ruby": ruby.check,
    "haskell": layout.check_haskell,
    "fsharp": layout.check_fsharp,
}
