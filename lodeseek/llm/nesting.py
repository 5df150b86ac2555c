"""Room for recursive descent into texts of any nesting."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

#: Frames that a grammar may need for a character of text, so that no nesting is too deep. Calls from Python to Python lie
#: on the heap: a few KB for each open bracket, used only while it is open.
FRAMES = 30


@contextmanager
def room_for(text: str) -> Iterator[None]:
    """Raise the recursion limit by what ``text`` may need; afterwards it is as before, so texts don't affect each other."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(min(before + FRAMES * (len(text) + 100), 2**31 - 1))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)
