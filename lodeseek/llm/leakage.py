"""Problem 7: evaluation texts that leak into training text, found with a generalised suffix automaton.

The automaton is built over the words of all test items. Each document's words are streamed through it once; the
state holds the longest suffix of the words read that occurs in some item. Where that suffix reaches ``min_words``, the
items that hold it are read off the state's ancestor for ``min_words`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.tables import cut_lineage

MIN_WORDS = 12
#: Words of test items that one automaton may hold (about 300 bytes a word in each Python worker).
MAX_AUTOMATON_WORDS = 500_000

WORD = re.compile(r"[A-Za-z0-9]+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences, with the items of each state of at least ``min_words``."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.word_ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(item, [self.word_ids.setdefault(w, len(self.word_ids)) for w in words]) for item, words in items]
        for _, word_codes in coded:
            last = 0
            for code in word_codes:
                last = self._extend(last, code)
        self._name_states(coded)

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, code: int) -> int:
        """The state for the longest suffix that reaches q from p, taken out of q if q also holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(code) == q:
            self.next[p][code] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return self._split(last, known, code)
        state = self._add(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and code not in self.next[p]:
            self.next[p][code] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, self.next[p][code], code)
        return state

    def _name_states(self, coded: list[tuple[int, list[int]]]) -> None:
        """anchor: for each state its ancestor (or itself) that holds the last min_words words; items: of the anchors."""
        self.anchor = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= self.min_words:
                above = self.link[s]
                self.anchor[s] = s if self.length[above] < self.min_words else self.anchor[above]
        self.items: dict[int, set[int]] = {}
        for item, word_codes in coded:
            s = 0
            for position, code in enumerate(word_codes, 1):
                s = self.next[s][code]
                if position >= self.min_words:
                    self.items.setdefault(self.anchor[s], set()).add(item)

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, set[int]]]:
        """(last word's index, matched length, items) wherever min_words successive words lie in an item."""
        follow, link, length, ids = self.next, self.link, self.length, self.word_ids
        s = matched = 0
        for i, word in enumerate(words):
            code = ids.get(word)
            if code is None:
                s = matched = 0
                continue
            step = follow[s].get(code)
            if step is None:
                while s and code not in follow[s]:
                    s = link[s]
                matched = length[s]
                step = follow[s].get(code)
                if step is None:
                    continue
            s = step
            matched += 1
            if matched >= self.min_words:
                yield i, matched, self.items[self.anchor[s]]


def _item_blocks(items: DataFrame, max_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of at most about ``max_words`` words, one block on the driver at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    # A word and what parts it from the next take two characters at least.
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    blocks = int(total // max_words) + 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", F.lit(7)), F.lit(blocks)) == block) if blocks > 1 else items
        rows = part.distinct().collect()
        yield [(r.item_id, words_of(r.text)) for r in sorted(rows)]


def _stream(documents: DataFrame, items: DataFrame, min_words: int, max_words: int, schema: str, scan) -> DataFrame:
    """The rows of ``scan(automaton, doc_id, text)`` for every document, from one pass for each block of items."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    names = [f.split()[0] for f in schema.split(", ")]
    found = []
    for block in _item_blocks(items, max_words):
        shared = documents.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, min_words))

        def scan_batches(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [r for d, t in zip(batch["doc_id"], batch["text"]) for r in scan(shared.value, d, t)]
                yield pd.DataFrame(rows, columns=names)

        if found:  # each block's rows are written before the next automaton is made
            found[-1] = cut_lineage(found[-1])
        found.append(documents.mapInPandas(scan_batches, schema))
    return reduce(DataFrame.unionByName, found)


LEAKS = "doc_id long, item_id long, spans int, longest int"


def find_leaks(
    documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_AUTOMATON_WORDS
) -> DataFrame:
    """Documents that hold at least ``min_words`` successive words of an item, with the items.

    Columns: doc_id, item_id, spans (separate places in the document) and longest (the longest run of words at such a
    place that lies in some item). Words are runs of ASCII letters and digits, compared without case. Null texts and
    ids, empty texts and items of fewer words match nothing; repeated documents give one row a pair (the largest
    counts). Only the named columns are read. The automaton is broadcast: its size is bounded by ``max_words``; more
    items are taken in several blocks, each against all documents.
    """

    def scan(automaton: SuffixAutomaton, doc_id: int, text: str):
        spans: dict[int, int] = {}
        longest: dict[int, int] = {}
        seen_at: dict[int, int] = {}
        for i, matched, items in automaton.matches(words_of(text)):
            for item in items:
                if seen_at.get(item) != i - 1:
                    spans[item] = spans.get(item, 0) + 1
                seen_at[item] = i
                longest[item] = max(longest.get(item, 0), matched)
        return [(doc_id, item, n, longest[item]) for item, n in spans.items()]

    found = _stream(documents, items, min_words, max_words, LEAKS, scan)
    return found.groupBy("doc_id", "item_id").agg(F.max("spans").alias("spans"), F.max("longest").alias("longest"))


SPANS = "doc_id long, text_hash long, first int, last int, longest int"
CLEANED = "doc_id long, text string, n_words int, leaked_words int, longest int, dropped boolean"


def _text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words in order, those that touch put together."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def remove_leaks(
    documents: DataFrame,
    items: DataFrame,
    min_words: int = MIN_WORDS,
    max_span: int = 0,
    max_coverage: float = 0.5,
    max_words: int = MAX_AUTOMATON_WORDS,
) -> DataFrame:
    """The documents with leaked passages, without these passages: one row for each doc_id and text.

    A passage of more than ``max_span`` matching words is cut out of the text; if more than ``max_coverage`` of the
    words match, the whole text is dropped (text is null, dropped is true). Columns: doc_id, text, n_words,
    leaked_words, longest, dropped. Documents without a leak aren't returned; nulls are treated as in ``find_leaks``.
    The matching spans of all blocks of items are brought together by document before anything is cut: as many as the
    document has words at most.
    """

    def scan(automaton: SuffixAutomaton, doc_id: int, text: str):
        found = [(i - matched + 1, i, matched) for i, matched, _ in automaton.matches(words_of(text))]
        longest = max((matched for *_, matched in found), default=0)
        key = _text_hash(text) if found else 0
        return [(doc_id, key, a, b, longest) for a, b in _joined([(a, b) for a, b, _ in found])]

    spans = _stream(documents, items, min_words, max_words, SPANS, scan)
    gathered = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.max("longest").alias("longest"))

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([_text_hash(t) for t in texts], dtype="int64")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, listed, longest in zip(batch["doc_id"], batch["text"], batch["spans"], batch["longest"]):
                places = list(WORD.finditer(text))
                own = _joined([(x["first"], x["last"]) for x in listed])
                leaked = sum(b - a + 1 for a, b in own)
                if leaked > max_coverage * len(places):
                    rows.append((doc_id, None, len(places), leaked, longest, True))
                    continue
                kept, at = [], 0
                for a, b in own:
                    if b - a + 1 > max_span:
                        kept.append(text[at : places[a].start()])
                        at = places[b].end()
                rows.append((doc_id, "".join(kept) + text[at:], len(places), leaked, longest, False))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in CLEANED.split(", ")])

    found = gathered.select("doc_id").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    texts = texts.join(found, "doc_id", "left_semi").withColumn("text_hash", hashed("text"))
    leaking = texts.join(gathered, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return leaking.select("doc_id", "text", "spans", "longest").mapInPandas(cut, CLEANED)
