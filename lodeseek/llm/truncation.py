"""Problem 9: texts cut off by a field limit or in mid-transfer.

Lengths of every text are recomputed as other systems would have counted them: in bytes, in UTF-16 units, with HTML or
JSON escapes, with CRLF line ends. Grouped by source and way of counting, a storage limit shows as a length at which
texts pile up although hardly any is longer. A text at such a limit, or shorter than its recorded length, is suspect;
then its ending is inspected. Endings that are unfinished whatever the length (an open code block, half a sentence, a
mark of omission) are found without a limit too.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.sources.tables import cut_lineage

#: A mark that a system puts in place of what it cut.
OMISSION = r"\s*(?:\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|(?:\.\.\.|…))\s*\z"


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def lengths(text: Column) -> dict[str, Column]:
    """Length of ``text`` under each way of counting."""
    chars, octets = F.length(text), F.octet_length(text)
    line_ends = _count(text, "\n")
    angle = 4 * _count(text, "&") + 3 * (_count(text, "<") + _count(text, ">"))
    quotes = 5 * _count(text, '"')
    backslashed = line_ends + _count(text, '"') + _count(text, "\\") + _count(text, "\t") + _count(text, "\r")
    plain = octets == chars  # most texts are ASCII, for which the dearer counts aren't needed
    wide = F.when(plain, chars).otherwise(F.octet_length(F.encode(text, "UTF-16BE")) / 2)
    not_ascii = F.when(plain, 0).otherwise(F.regexp_count(text, F.lit(r"[^\x00-\x7F]")))
    return {
        "chars": chars,
        "utf8": octets,
        "utf16": wide.cast("int"),
        "html": chars + angle,
        "html_quotes": chars + angle + quotes,
        "html_utf8": octets + angle,
        "html_quotes_utf8": octets + angle + quotes,
        "json": chars + backslashed,
        "json_utf8": octets + backslashed,
        "json_ascii": (wide + 5 * (not_ascii + wide - chars)).cast("int") + backslashed,
        "crlf": chars + line_ends,
        "crlf_utf8": octets + line_ends,
    }


def without_mark(text: Column) -> Column:
    """``text`` without a mark of omission at its end, or without what stands for a character that was cut apart; only
    ends that have one are rewritten."""
    marked, broken = F.right(text, F.lit(12)).rlike(OMISSION), F.endswith(text, F.lit("\ufffd"))
    return F.when(marked, F.regexp_replace(text, OMISSION, "")).when(broken, F.rtrim(text, F.lit("\ufffd"))).otherwise(text)


_FENCE = re.compile(r"^[ \t]*(?:```|~~~)", re.MULTILINE)
_MARK = re.compile(OMISSION.replace(r"\z", r"\Z"))
_SENTENCE_END = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\Z")
_CLOSED_QUOTE = re.compile(r"[\"”»]\Z")
_TABLE_ROW = re.compile(r"\|.*\|\Z")
_CHECK_ENTRY = re.compile(r"[-*+] \[[ xX]\] \S.*\Z")
_LIST_ENTRY = re.compile(r"(?:[-*+•]|\d+[.)]) +(.*)\Z", re.DOTALL)
_REFERENCE = re.compile(
    r"(?:[A-Z][\w-]*(?: [a-z]+)?: ?(?:#?\d+|[\w-]+|\S*[/.#]\S*)(?:, ?#?\w+)*|<?https?://\S+|\[\d+\]:? .*|#\d+)\Z"
)
_REMARK = re.compile(r"(?:[A-Z]{2,6}|[:;=8xX][-^o']?[()DPpO/|\\\]]|\+1|-1|\W{1,4})\Z")
_BRACKETED = re.compile(r"[(\[][^()\[\]]*[)\]]\Z")
_SENTENCE = re.compile(r"(?<=[.?!]) ")
_SIGNATURE = re.compile(r"(?:--|—|–|/|~|@)\s?\S.*\Z")
_GREETING = re.compile(r"[^\n.?!]{1,30},\Z")


def ending(text: str) -> str:
    """What the end of a text is: open_code, omission, broken_char, open, weak (complete if not cut by a limit), closed."""
    if len(_FENCE.findall(text)) % 2:
        return "open_code"
    body = text.rstrip()
    mark = _MARK.search(body)
    if mark and mark.start():
        return "closed" if _SENTENCE_END.search(body[: mark.start()]) and mark.group().strip() == "..." else "omission"
    if body.endswith("�"):
        return "broken_char"
    lines = body.split("\n")
    last = lines[-1].strip()
    if not last:
        return "closed"
    if _FENCE.match(last) or _SENTENCE_END.search(last) or _TABLE_ROW.match(last):
        return "closed"
    if _CHECK_ENTRY.match(last):
        return "weak" if len(last.split()) <= 8 else "open"
    entry = _LIST_ENTRY.match(last)
    if entry:
        words = entry.group(1).split()
        siblings = [m.group(1) for line in lines[:-1] if (m := _LIST_ENTRY.match(line.strip()))]
        loose = siblings and sum(not _SENTENCE_END.search(s) for s in siblings) > len(siblings) / 2
        short = 0 < len(words) <= 3 and not words[0][0].isupper()
        return "weak" if loose or short else "open"
    piece = _SENTENCE.split(last)[-1]  # a remark or signature may stand behind the last sentence
    if any(x.match(piece) for x in (_REFERENCE, _BRACKETED, _REMARK)) or _BRACKETED.match(last):
        return "weak"
    if _SIGNATURE.match(piece) and len(piece.split()) <= 6:
        return "weak"
    above = lines[-2].strip() if len(lines) > 1 else ""
    if above and _GREETING.match(_SENTENCE.split(above)[-1]) and len(last.split()) <= 4:
        return "weak"
    if last.startswith("#"):
        return "weak"
    return "open"


def sized_texts(documents: DataFrame) -> DataFrame:
    """What one pass over the texts tells of each document: doc_id, source, n_chars, text_hash, sizes (one a way of
    counting, without a mark of omission), most (the largest length of the whole text, where ``n_chars`` is above its
    characters), ending. A null text's sizes are null and its end is closed."""

    @F.pandas_udf("string")
    def endings(texts: pd.Series) -> pd.Series:
        return pd.Series(["closed" if not t else ending(t) for t in texts], dtype=object)

    one = documents.select("doc_id", "source", "n_chars", "text", without_mark(F.col("text")).alias("_bare"))
    most = F.greatest(*lengths(F.col("text")).values())
    return one.select(
        "doc_id",
        "source",
        "n_chars",
        F.xxhash64("_bare").alias("text_hash"),
        F.array(*[v.cast("int") for v in lengths(F.col("_bare")).values()]).alias("sizes"),  # unconditional: counts are shared
        F.when(F.col("n_chars") > F.length("text"), most).alias("most"),
        endings("text").alias("ending"),
    )


def hidden_limits(documents: DataFrame, min_texts: int = 5, min_share: float = 0.3, slack: int = 3) -> DataFrame:
    """Storage limits that texts of a source run into: source, counting, length, texts (different texts at the limit).

    A length is a limit if at least ``min_texts`` different texts have it, at most a tenth as many are more than
    ``slack`` longer, and these texts are at least ``min_share`` of those that reach nine tenths of it. A mark of
    omission at the end isn't counted. Null texts don't count; a null source is a source of its own.
    """
    return _limits(sized_texts(documents), min_texts, min_share, slack)


def _limits(sized: DataFrame, min_texts: int = 5, min_share: float = 0.3, slack: int = 3) -> DataFrame:
    # Copies count once; then one row for each length that occurs, which pre-aggregates before the second shuffle.
    texts = sized.where(F.get("sizes", F.lit(0)).isNotNull()).groupBy("source", "text_hash").agg(F.first("sizes").alias("sizes"))
    named = F.arrays_zip(F.array(*map(F.lit, lengths(F.lit("")))).alias("counting"), F.col("sizes").alias("length"))
    by_length = texts.select("source", F.inline(named).alias("counting", "length")).groupBy("source", "counting", "length").agg(F.count("*").alias("texts"))
    # Frames over the lengths of a source: one row a length, however many texts there are. Nine tenths of a length lie a
    # fixed distance below it on a logarithmic scale. Frames begin at the longest text, so that they only grow.
    partition = "PARTITION BY source, counting ORDER BY"
    near = F.expr(f"sum(texts) OVER ({partition} ln(length) DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {-math.log(0.9)!r}D FOLLOWING)")
    beyond = F.expr(f"sum(texts) OVER ({partition} length DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {slack + 1} PRECEDING)")
    framed = by_length.where(F.col("length") > 0).withColumn("near", near).withColumn("beyond", F.coalesce(beyond, F.lit(0)))
    limit = (F.col("texts") >= min_texts) & (F.col("beyond") * 10 <= F.col("texts"))
    return framed.where(limit & (F.col("texts") >= F.col("near") * min_share)).select("source", "counting", "length", "texts")


def find_truncated(documents: DataFrame) -> DataFrame:
    """Every document with what is known of its end: doc_id, source, ending, limit, truncated.

    ``limit`` names the way of counting under which the text (without a mark of omission) just fills a hidden limit of
    its source, "recorded" if ``n_chars`` is above every length that the text can have, or is null. ``truncated`` is
    true for an ending that is unfinished in itself, and for a weak one (list entry, reference, remark, signature) at a
    limit. Null and empty texts aren't truncated; repeated rows are judged alike. Only doc_id, text, source and n_chars
    are read; each text is gone through once.
    """
    seen = cut_lineage(sized_texts(documents.withColumn("doc_id", F.col("doc_id").cast("long"))))
    by_source = _limits(seen).groupBy("source").agg(
        F.collect_list(F.struct("counting", "length")).alias("_limits")  # one element a limit: a handful a source
    )
    left, right = seen.where(F.col("doc_id").isNotNull()).alias("d"), by_source.alias("l")
    joined = left.join(right, F.col("d.source").eqNullSafe(F.col("l.source")), "left")
    place = {name: n for n, name in enumerate(lengths(F.lit("")))}
    places = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    hit = F.filter("_limits", lambda x: F.get("sizes", F.element_at(places, x["counting"])).between(x["length"] - 3, x["length"]))
    limit = F.when(F.size(hit) > 0, F.array_min(F.transform(hit, lambda x: x["counting"]))).when(
        F.col("n_chars") > F.col("most"), F.lit("recorded")
    )
    unfinished = F.col("ending").isin("open_code", "omission", "broken_char", "open")
    return joined.select(
        "doc_id",
        F.col("d.source").alias("source"),
        "ending",
        limit.alias("limit"),
        (unfinished | ((F.col("ending") == "weak") & limit.isNotNull())).alias("truncated"),
    )


def truncation_rates(found: DataFrame) -> DataFrame:
    """For each source: documents, truncated, rate, and the share of the truncated that sit at a known limit."""
    cut = F.sum(F.col("truncated").cast("long"))
    return found.groupBy("source").agg(
        F.count("*").alias("documents"),
        cut.alias("truncated"),
        F.round(cut / F.count("*"), 6).alias("rate"),
        F.sum((F.col("truncated") & F.col("limit").isNotNull()).cast("long")).alias("at_limit"),
    )
