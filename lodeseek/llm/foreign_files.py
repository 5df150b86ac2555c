"""Problem 2: generated, minified, vendored and data files, so that only hand-written source remains.

Three kinds of evidence: the path and the notes at the head of a file; an inverted index of rare line hashes that gives,
for every file, the exact share of its rare lines found in one file of another repository; and, for what remains, the
composition of its tokens.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.llm.file_text import map_files
from lodeseek.sources.tables import cut_lineage

#: A line is rare if at most so many different texts hold it.
RARE = 50
#: Share of a file's rare lines from which on it is contained in a file of another repository.
CONTAINED = 0.8

# -- paths ----------------------------------------------------------------------------------------------------------

_GENERATED_PATH = re.compile(
    r"(?:^|/)(?:gen|generated|__generated__|autogen|auto_generated)/[^/]*"
    r"|\.(?:generated|gen|g|pb|designer|g\.i)\.\w+$|_(?:pb2|pb2_grpc|pb|gen|generated|string)\.\w+$|(?:^|/)zz_generated[^/]*$",
    re.IGNORECASE,
)
_MINIFIED_PATH = re.compile(r"\.min\.\w+$|[.-](?:bundle|chunk)\.\w+$|\.[0-9a-f]{8,20}\.(?:js|mjs|cjs|jsx|css)$")
_PACKAGE_DIRS = (
    "vendor", "third_party", "third-party", "thirdparty", "node_modules", "Godeps", "site-packages", "dist-packages",
    "external", "extern", "deps", "bower_components", "Pods", "jspm_packages", "_vendor",
)
_VENDORED_PATH = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, _PACKAGE_DIRS))})/[^/]+/")
_VENDOR_HINT = re.compile(rf"(?:^|/)(?:{'|'.join(map(re.escape, (*_PACKAGE_DIRS, 'vendors', 'vendored', 'contrib')))})/", re.I)

# -- notes ----------------------------------------------------------------------------------------------------------

_GENERATED_NOTE = re.compile(
    r"\bcode generated by\b|@generated\b|<auto-?generated ?/?>|^\W*auto-?generated (?:file|by|from|code)|"
    r"\b(?:this|the) (?:file|code|module|class) (?:was|is|has been) (?:auto(?:matically)?[- ]?)?(?:generated|written|produced|created) (?:by|from|with)\b|"
    r"\bautomatically (?:generated|produced|created) (?:by|from)\b|^\W*(?:machine|auto)[- ](?:written|generated|made) ?(?:\(|by|from|file)|"
    r"\b(?:generated|created|produced|written) by (?:the )?\S+ (?:compiler|generator|codegen)\b|"
    r"^\W*generated (?:by|from|with)\b.*|\bdo not (?:edit|modify)(?: (?:this file|by hand|manually))?\W*$",
    re.IGNORECASE,
)
_NOT_GENERATED = re.compile(
    r"\b(?:used to be|was once|no longer|not|never|formerly) (?:auto-?)?generated|maintained by hand|written by hand|"
    r"\b(?:writes?|prints?|emits?|adds?|finds?|detects?|checks?|strips?|removes?) (?:the|a|an|all|any)\b.*(?:banner|header|note|mark)|"
    r"method stub|\b(?:edit|modify) with care\b",
    re.IGNORECASE,
)
_ORIGIN_NOTE = re.compile(
    r"\b(?:vendored|copied|taken|imported|borrowed|adapted|ported|forked)\b(?: \w+)? (?:from|at)\s+(?:the |upstream )?(?P<a>[\w.-]+)|"
    r"\bcopyright\b(?:\s*\(c\)|\s*©)?\s*[\d, -]+\s*(?:by )?(?:the )?(?P<b>[\w.-]+(?: [\w.-]+)??) (?:authors|developers|contributors|team|project|foundation|inc|llc|gmbh|ltd)\b|"
    r"\bSPDX-FileCopyrightText:\s*(?:\(c\)|©)?\s*[\d, -]+\s*(?P<c>[\w.-]+)|"
    r"^\W*(?P<d>[\w.-]+) v?\d+(?:\.\d+)+\s*\|\s*\(c\)\s*[\d, -]+",
    re.IGNORECASE,
)
_NOT_ORIGIN = re.compile(r"\b(?:replaces?|instead of|replaced|removes?|drops?|unlike|part of this repository)\b", re.IGNORECASE)

_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\[|!\[|include|define|if|pragma)|/?\*|--|\{-|-\}|;;|<!--|'''|\"\"\"|=begin|=end|\(\*)")
_DOC_LINE = re.compile(r"\s*(?:///|/\*\*(?!\*)|-- [|^]|\{- ?[|^])")
_BLOCK_OPEN = {"/*": "*/", "{-": "-}", '"""': '"""', "'''": "'''", "=begin": "=end", "<!--": "-->", "(*": "*)"}


def head_comments(text: str) -> tuple[list[str], list[str]]:
    """(file comments, doc comments) at the head: all lines before the first code.

    A doc comment belongs to the definition below it, not to the file, unless a blank line parts them.
    """
    own: list[str] = []
    docs: list[str] = []
    lines = text.split("\n")
    close, doc, block = "", False, []

    def flush(attached: bool):
        (docs if doc and attached else own).extend(block)
        block.clear()

    for line in lines:
        stripped = line.strip()
        if close:
            block.append(stripped)
            if close in stripped:
                close = ""
            continue
        if not stripped:
            flush(False)
            doc = False
            continue
        if not _COMMENT_LINE.match(line):
            break
        doc = doc or bool(_DOC_LINE.match(line))
        block.append(stripped)
        for mark, end in _BLOCK_OPEN.items():
            if stripped.startswith(mark):
                rest = stripped[len(mark) :]
                if end not in rest:
                    close = end
                break
    flush(True)
    return own, docs


def _same_project(origin: str, repo: str | None, path: str) -> bool:
    plain = lambda x: re.sub(r"[^a-z0-9]", "", x.lower())
    own = {plain(repo or ""), plain(path.split("/")[0])} - {""}
    name = plain(origin)
    return any(name == o for o in own) or name in ("us", "me", "ours", "our", "own", "this", "team", "maintainers", "project", "the")


def notes(text: str, repo: str | None, path: str) -> dict[str, bool]:
    """What the comments at the head say: generated, vendored (an origin other than the file's repository)."""
    own, docs = head_comments(text)
    generated = any(_GENERATED_NOTE.search(x) and not _NOT_GENERATED.search(x) for x in own + docs)
    origin = hint = False
    for lines, firm in ((own, True), (docs, False)):
        for line in lines:
            m = _ORIGIN_NOTE.search(line)
            if m and not _NOT_ORIGIN.search(line):
                named = next(g for g in m.groups() if g)
                if not _same_project(named, repo, path):
                    origin, hint = origin or firm, hint or not firm
    return {"generated_note": generated, "origin_note": origin, "origin_hint": hint}


# -- composition ----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?\*/|(?P<hash>#[^\n]*)|--[ |][^\n]*|\{-[\s\S]*?-\}"
    r"|(?P<string>\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|`[^`]*`|'(?:[^'\\\n]|\\.)*')"
    r"|(?P<number>\d[\w.]*)|(?P<word>[^\W\d]\w*)"
)
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{40,}")


def composition(text: str) -> dict[str, float]:
    """Shares that tell written code from data, squeezed code and generated code."""
    words = literals = literal_chars = encoded = 0
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            words += 1
        elif kind == "number":
            literals += 1
            literal_chars += m.end() - m.start()
        elif kind == "string":
            value = m.group()
            literals += 1
            literal_chars += len(value)
            if len(value) >= 200:
                encoded += sum(map(len, _ENCODED.findall(value)))
    lines = [s for line in text.split("\n") if (s := line.strip())]
    code = [s for s in lines if not _COMMENT_LINE.match(s)]
    chars = sum(map(len, lines)) or 1
    code_chars = sum(map(len, code)) or 1
    shapes = Counter(re.sub(r"\d+", "0", re.sub(r"[^\W\d]\w*", "w", s)) for s in code)
    return {
        "literal_share": literals / (literals + words or 1),
        "encoded_share": encoded / chars,
        "literals": literals,
        "literal_chars": literal_chars / code_chars,
        "shape_share": sum(n for _, n in shapes.most_common(2)) / (len(code) or 1),
        "code_lines": len(code),
        "long_share": sum(len(s) for s in code if len(s) >= 300) / code_chars,
        "space_share": sum(map(str.isspace, text)) / (len(text) or 1),
        "code_chars": code_chars,
    }


def looks_minified(c: dict[str, float]) -> bool:
    return c["long_share"] >= 0.7 and c["space_share"] < 0.09 and c["encoded_share"] < 0.3 and c["literal_share"] < 0.6


def looks_data(c: dict[str, float]) -> bool:
    tables = c["literals"] >= 60 and c["literal_share"] >= 0.85 and c["literal_chars"] >= 0.4
    return tables or c["encoded_share"] >= 0.6 and c["code_chars"] >= 600


def looks_generated(c: dict[str, float]) -> bool:
    return c["code_lines"] >= 8 and c["shape_share"] >= 0.7 and not looks_data(c) and not looks_minified(c)


_USEFUL = re.compile(r"\w.*\w.*\w.*\w.*\w.*\w")


def line_hashes(text: str) -> list[int]:
    """Distinct hashes of the lines that say something, without their indentation."""
    lines = {s for line in text.split("\n") if len(s := line.strip()) >= 12 and _USEFUL.search(s)}
    return sorted({xxhash.xxh64_intdigest(s) - (1 << 63) for s in lines})


SIGNS = (
    "file_path string, language string, repo string, generated_path boolean, generated_note boolean, generated_look boolean, "
    "minified_path boolean, minified_look boolean, vendored_path boolean, origin_note boolean, vendor_hint boolean, "
    "data_look boolean, text_hash long, line_hashes array<long>"
)


def file_signs(chunks: DataFrame) -> DataFrame:
    """What path, head notes and token composition say of each file, and the hashes of its lines."""

    def one(path: str, language: str | None, repo: str | None, text: str) -> list[tuple]:
        said = notes(text, repo, path)
        c = composition(text)
        hint = said["origin_hint"] or bool(_VENDOR_HINT.search(path))
        row = (
            path, language, repo,
            bool(_GENERATED_PATH.search(path)), said["generated_note"], looks_generated(c),
            bool(_MINIFIED_PATH.search(path)), looks_minified(c),
            bool(_VENDORED_PATH.search(path)), said["origin_note"], hint,
            looks_data(c), xxhash.xxh64_intdigest(text) - (1 << 63), line_hashes(text),
        )
        return [row]

    return map_files(chunks, one, SIGNS)


def containment(signs: DataFrame, rare: int = RARE) -> DataFrame:
    """For each file: file_path, language, and the largest share of its rare lines in one file of another repository
    (contained), with that file (origin_path), if it is at least CONTAINED; and whether it is the copy (copied). Of two
    files that contain each other, text doesn't tell which came first: one of which directory or comment tell nothing
    counts as the origin before one of which they do, and then the one with the smaller path.

    A line is rare if it occurs in at most ``rare`` different texts; equal texts count once, so that many copies of a
    file don't make its lines common. Lines that more texts share are boilerplate and count neither for nor against.
    If less than half of a text's lines are rare, as in a library that many repositories hold with small edits, the share
    is of all its lines: a file that holds CONTAINED of them holds one of the rarest few (``_common_share``).
    The index holds one row for each text and line that another text has too; lines that one text alone has are counted only.
    """
    texts = signs.groupBy("text_hash").agg(F.first("line_hashes").alias("line_hashes"))
    lines = texts.select("text_hash", F.explode("line_hashes").alias("line"))
    shared = lines.groupBy("line").agg(F.count("*").alias("texts")).where("texts > 1")
    index = cut_lineage(lines.join(shared, "line"))
    held = index.groupBy("text_hash").agg(F.count("*").alias("shared"), F.count_if(F.col("texts") > rare).alias("often"))
    size = signs.groupBy("text_hash").agg(F.first(F.size("line_hashes")).alias("lines")).join(held, "text_hash")
    size = cut_lineage(size.withColumn("size", F.col("lines") - F.col("often")))
    common_lined = size.where(2 * F.col("size") < F.col("lines"))
    size = size.where(2 * F.col("size") >= F.col("lines")).select("text_hash", "size")
    few = index.where(F.col("texts") <= rare)
    a = few.join(size.select("text_hash"), "text_hash", "left_semi").select("line", F.col("text_hash").alias("a"))
    b = few.select("line", F.col("text_hash").alias("b"))
    common = a.join(b, "line").where("a != b").groupBy("a", "b").agg(F.count("*").alias("common"))
    share = common.join(size, common["a"] == size["text_hash"]).select("a", "b", (F.col("common") / F.col("size")).alias("share"))
    share = share.where(F.col("share") >= CONTAINED)
    share = share.unionByName(_common_share(index, common_lined))
    share = cut_lineage(share)
    back = share.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("mutual"))
    share = share.join(back, ["a", "b"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))
    itself = signs.where(F.size("line_hashes") > 0).select("text_hash").distinct()  # equal texts elsewhere
    share = share.unionByName(itself.select(F.col("text_hash").alias("a"), F.col("text_hash").alias("b"), F.lit(1.0).alias("share"), F.lit(True).alias("mutual")))
    # Copies of a text: the first ones in two repositories hold the first one that is foreign to any file.
    rank = F.struct((F.col("vendored_path") | F.col("origin_note") | F.col("vendor_hint")).alias("told"), "file_path")
    homes = signs.groupBy("text_hash", "repo").agg(F.min(rank).alias("home"))
    homes = homes.withColumn("_n", F.row_number().over(W.partitionBy("text_hash").orderBy("home"))).where("_n <= 2")
    found = (
        signs.select("file_path", "language", F.col("repo").alias("own"), F.col("text_hash").alias("a"), rank.alias("rank"))
        .join(share, "a")
        .join(homes.select(F.col("text_hash").alias("b"), "repo", "home"), "b")
        .where(~F.col("own").eqNullSafe(F.col("repo")))
    )
    return found.groupBy("file_path", "language").agg(
        F.max("share").alias("contained"),
        F.max_by("home.file_path", F.struct("share", "home.file_path")).alias("origin_path"),
        F.max(~F.col("mutual") | (F.col("home") < F.col("rank"))).alias("copied"),
    )


def _common_share(index: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, share of a's lines (all of them) in b, if at least CONTAINED, for ``texts`` (text_hash, lines, shared).

    Exact: b lacks at most a fifth of a's lines, so it has one of any greater number of them; the rarest are looked up. Lines
    that a alone has are the rarest, and there is nothing to look up for them.
    """
    own = cut_lineage(index.join(texts.select("text_hash", "lines", "shared"), "text_hash"))
    rarest = W.partitionBy("text_hash").orderBy("texts", "line")
    needed = F.floor(F.col("lines") * (1 - CONTAINED) + 1e-9) + 1 - (F.col("lines") - F.col("shared"))
    few = own.withColumn("n", F.row_number().over(rarest)).where(F.col("n") <= needed)
    pairs = few.select("line", F.col("text_hash").alias("a")).join(index.select("line", F.col("text_hash").alias("b")), "line")
    pairs = pairs.where("a != b").select("a", "b").distinct()
    both = own.select(F.col("text_hash").alias("a"), "lines", "line").join(pairs, "a")
    both = both.join(index.select(F.col("text_hash").alias("b"), "line"), ["b", "line"])
    share = both.groupBy("a", "b").agg((F.count("*") / F.max("lines")).alias("share"))
    return share.where(F.col("share") >= CONTAINED)


def classify_files(chunks: DataFrame, told: bool = False) -> DataFrame:
    """Every file with its kind: generated, minified, vendored, data, or hand (written in its own repository).

    Columns: file_path, language, repo, kind, reason, contained, origin_path. The first that holds decides: an origin
    told by directory or notice (vendored), a generator told by note or path, a squeezing tool told by path; then
    containment in a file of another repository, of which the file counts as the copy (vendored); then, for the remaining
    files, what their tokens are made of (squeezed code, data, generated code). With ``told``, a contained file is a copy
    only if a directory or a doc comment hints at an origin. Contained and origin_path are told of every file, whatever
    its kind. What makes up a file, and nulls and repeated rows: see ``map_files``; an empty text is hand.
    """
    signs = cut_lineage(file_signs(chunks))
    copied = F.coalesce(F.col("vendor_hint") & F.col("contained").isNotNull() if told else F.col("copied"), F.lit(False))
    rules = [
        ("vendored", "directory", F.col("vendored_path")),
        ("generated", "note", F.col("generated_note")),
        ("generated", "path", F.col("generated_path")),
        ("minified", "path", F.col("minified_path")),
        ("vendored", "notice", F.col("origin_note")),
        ("vendored", "contained", copied),
        ("minified", "content", F.col("minified_look")),
        ("data", "content", F.col("data_look")),
        ("generated", "content", F.col("generated_look")),
    ]
    kind = reason = None
    for k, r, holds in rules:
        kind = F.when(holds, k) if kind is None else kind.when(holds, k)
        reason = F.when(holds, r) if reason is None else reason.when(holds, r)
    left = signs.drop("line_hashes").alias("s")
    same = (F.col("s.file_path") == F.col("c.file_path")) & F.col("s.language").eqNullSafe(F.col("c.language"))
    joined = left.join(containment(signs).alias("c"), same, "left")
    return joined.select(
        "s.file_path", "s.language", "repo", kind.otherwise("hand").alias("kind"), reason.alias("reason"), "contained", "origin_path"
    )
