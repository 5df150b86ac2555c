"""Problem 6: cutting oversized chunks at natural boundaries by agglomerative merging.

Atomic segments are joined pairwise. A heap holds every pair of neighbours, weakest boundary first; a pair is merged
while the union, together with the lines it repeats from the piece before, fits the limit. Whatever boundaries remain
are the cuts.

Two orders of the heap are offered:

* ``forward``: all boundaries count as equally weak and the leftmost is merged first, so that each piece is as full as
  the rules of TESTDATA.md want it. A segment that doesn't fit is opened at its line breaks.
* ``weakest``: boundaries are ranked by what they cut (inside a block, at a dedent, at a blank line, before a
  definition at the margin), so that pieces end at the strongest places even if they are less full.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4000
OVERLAP = 3


class _Lines:
    """Lengths of a text's lines, with the size of any run of lines in constant time."""

    def __init__(self, lines: list[str]):
        self.n = len(lines)
        self.upto = [0]
        for line in lines:
            self.upto.append(self.upto[-1] + len(line) + 1)

    def size(self, first: int, last: int) -> int:
        """Characters of lines first..last with the line breaks between them."""
        return self.upto[last + 1] - self.upto[first] - 1

    def start_with_overlap(self, first: int, before: int, overlap: int, limit: int) -> int:
        """Where a piece whose first new line is ``first`` begins, if the piece before begins at ``before``."""
        start = max(first - overlap, before + 1)
        while start < first and self.size(start, first) > limit:
            start += 1
        return start


def forward_pieces(lines: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """First and last line of each piece; no line may be longer than ``limit``."""
    sizes = _Lines(lines)
    blank = [not line.strip() for line in lines]
    ends = [i for i in range(sizes.n - 1) if not blank[i] and blank[i + 1]] + [sizes.n - 1]
    ends = sorted(set(ends))
    # Segment j is (first new line, last line); the open segment also has the line where its overlap begins.
    segments = list(zip([0, *[e + 1 for e in ends[:-1]]], ends))
    heap = [(0, j) for j in range(len(segments) - 1)]
    heapq.heapify(heap)
    pieces: list[tuple[int, int]] = []
    start, (first, last) = 0, segments[0]

    def open_up(start: int, first: int, last: int) -> tuple[int, int, int]:
        """Close pieces of full lines until what is left of the open segment fits."""
        while sizes.size(start, last) > limit:
            end = first
            while sizes.size(start, end + 1) <= limit:
                end += 1
            pieces.append((start, end))
            start, first = sizes.start_with_overlap(end + 1, start, overlap, limit), end + 1
        return start, first, last

    start, first, last = open_up(start, first, last)
    while heap:
        _, j = heapq.heappop(heap)
        following = segments[j + 1]
        if sizes.size(start, following[1]) <= limit:
            last = following[1]
        else:
            pieces.append((start, last))
            start = sizes.start_with_overlap(following[0], start, overlap, limit)
            start, first, last = open_up(start, *following)
    pieces.append((start, last))
    return pieces


_MARGIN_CODE = re.compile(r"[A-Za-z@#/<\[]")


def boundary_strength(before: str, after: str) -> int:
    """How natural a cut between two successive lines is: 0 within a block up to 3 before a definition at the margin."""
    if not before.strip():
        return 3 if _MARGIN_CODE.match(after) else 2
    if not after.strip():
        return 1
    indent = len(after) - len(after.lstrip())
    return 1 if indent < len(before) - len(before.lstrip()) else 0


def weakest_pieces(lines: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """First and last line of each piece, overlap included, merging the weakest boundaries first."""
    sizes = _Lines(lines)
    n = sizes.n
    left = list(range(-1, n - 1))
    right = [*range(1, n), -1]
    last = list(range(n))
    alive = [True] * n

    def fits(first: int, end: int) -> bool:
        return sizes.size(max(0, first - overlap), end) <= limit or sizes.size(first, end) <= limit and first == 0

    heap = [(boundary_strength(lines[i], lines[i + 1]), i, i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, at, i, until = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or last[i] != at or last[j] != until or not fits(i, until):
            continue
        alive[j], last[i], right[i] = False, until, right[j]
        if right[i] >= 0:
            left[right[i]] = i
            k = right[i]
            heapq.heappush(heap, (boundary_strength(lines[until], lines[k]), until, i, last[k]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (boundary_strength(lines[last[k]], lines[i]), last[k], k, until))
    pieces, i, before = [], 0, -1
    while i >= 0:
        start = i if not pieces else sizes.start_with_overlap(i, before, overlap, limit)
        while start < i and sizes.size(start, last[i]) > limit:
            start += 1
        pieces.append((start, last[i]))
        before, i = start, right[i]
    return pieces


def cut_long_line(line: str, limit: int) -> list[tuple[int, int]]:
    """Character ranges of a line longer than ``limit``: cuts fall behind separators, else between words, else anywhere."""
    ranges, start = [], 0
    while len(line) - start > limit:
        window = line[start : start + limit]
        cut = max((window.rfind(x) for x in ";},"), default=-1) + 1
        if cut < limit // 2:
            cut = max(cut, window.rfind(" ") + 1)
        if cut < limit // 2:
            cut = limit
        ranges.append((start, start + cut))
        start += cut
    ranges.append((start, len(line)))
    return ranges


def split_text(text: str, limit: int, overlap: int, order: str) -> list[tuple[int, int, int, int]]:
    """Pieces as (first line, last line, first column, column behind the end); columns count within those two lines.

    A line of more than ``limit`` characters is cut inside and stands alone; the lines around it are split as usual.
    """
    split = forward_pieces if order == "forward" else weakest_pieces
    lines = text.split("\n")
    out: list[tuple[int, int, int, int]] = []
    run = 0
    for i in [i for i, line in enumerate(lines) if len(line) > limit] + [len(lines)]:
        if run < i:
            out += [(run + a, run + b, 0, len(lines[run + b])) for a, b in split(lines[run:i], limit, overlap)]
        if i < len(lines):
            out += [(i, i, a, b) for a, b in cut_long_line(lines[i], limit)]
        run = i + 1
    return out


PIECES = "chunk_id long, piece_no int, start_line int, end_line int, start_col int, end_col int, long_line boolean"


def split_oversized(
    chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, order: str = "forward"
) -> DataFrame:
    """The pieces of each row of ``chunks`` whose content has more than ``limit`` characters.

    Columns: chunk_id, piece_no from 0, start_line and end_line of the file, start_col and end_col (0-based, end
    exclusive) within these lines, and long_line, true if the row holds a line of more than ``limit`` characters.
    Null or short content gives no piece; a null start_line counts as 0; repeated rows give repeated pieces. Only the
    three columns named are read, so further columns don't matter. Rows are independent: no shuffle, and only
    oversized rows reach Python.
    """
    if limit < 1 or overlap < 0:
        raise ValueError("limit must be at least 1 and overlap at least 0")
    rows = chunks.select("chunk_id", "content", F.coalesce("start_line", F.lit(0)).alias("start_line"))
    rows = rows.where(F.length("content") > limit)

    def split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk_id, content, start in zip(batch["chunk_id"], batch["content"], batch["start_line"]):
                long_line = max(map(len, content.split("\n"))) > limit
                for no, (a, b, c, d) in enumerate(split_text(content, limit, overlap, order)):
                    out.append((chunk_id, no, start + a, start + b, c, d, long_line))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PIECES.split(", ")])

    return rows.mapInPandas(split_batches, PIECES)
