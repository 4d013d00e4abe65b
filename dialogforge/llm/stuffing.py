"""Keyword-stuffed pages, link lists and tag or product lists.

Two kinds of evidence are joined. The first is within a page: the share of its words that stand in link lines, in lists of
short entries, in runs of words that are no sentences, or in sentences that repeat one keyword (list density). The second
is between pages: the phrases of all pages (shingles of five words, and whole entries that are shorter) are exploded, the
distinct hosts of every phrase are counted over the whole corpus, and the words of the page's lists that stand in phrases
which other hosts use too are its stitched share. A page is a case if density and stitched share together reach ``CASE``:
a page that is hardly anything but a list is one by itself, one with more text beside it only if its lists are made of
phrases replicated elsewhere. Phrases keep their real words; numbers, the page's own keywords (so that "Find X and Y with X
today" is one phrase wherever it is used) and the paths of links stand for their kind, a link is its site.

Scale: one pass of Python makes the evidence and the phrases; phrases are counted by map-side combined aggregations over
(phrase, host) and then phrase, so that a phrase of any number of pages is spread over tasks; only pages whose density
reaches half of ``CASE`` are joined with the counts, as the stitched share is never above the density.

Defined results: null ids or texts and texts without words are no case; pages without host don't count as hosts; copies of
one text are judged alike and count for one host; repeated ids give one row; columns other than those named
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogforge.session import BROADCAST_ROWS, cut

SHINGLE = 5
#: Least sum of list density and stitched share of a case, and least number of hosts of a replicated phrase.
CASE, HOSTS = 0.85, 2
#: A keyword that makes up this share of the words of its sentences is stuffed.
KEYWORD_SHARE, KEYWORD_DISTINCT = 0.1, 0.5
#: A page's own keywords: words that make up this share of its words, function words and numbers aside, and stand there so often.
OWN_SHARE, OWN_TIMES = 0.05, 4

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_LINK = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>]+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/[^\s<>]*", re.I)
_SITE = re.compile(r"(?:https?://|www\.)*((?:[a-z0-9-]+\.)+[a-z]{2,})", re.I)
_WORD = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
_PARTS = re.compile(r"[|·•,;/>#\t]|\s-\s| {2,}")
#: A line's words and the marks that end an entry or a clause.
_TOKEN = re.compile(r"[^\W_]+(?:_[^\W_]+)*|[.!?:;,|·•#/>()\[\]\"\t]+|\s-\s| {2,}")
#: What a line must hold for a link to be in it.
_LINK_SIGN = re.compile(r"://|www\.|</a>|\]\(|\.[a-z]{2,}/", re.I)
_SENTENCE_END = re.compile(r"[.!?:…]['\")\]]*$|[.!?]\s")
_ITEM = re.compile(r"^\s*(?:[-*+]|\d+[.)]|\[\d+\])\s")
#: Function words of the corpus languages; words that make a line a sentence (fixed list).
_FUNCTION = frozenset(
    "the a an is are was were and or of to that which with for it its in this these not no you your we i on at as be by from if can has have had do does will would should so then than when while but into over before after each "
    "der die das den dem ein eine einen und ist sind nicht mit auf im in wie dass von zu sich wird wenn für so noch nur dann als oder aber "
    "le la les un une des du et est sont que qui dans pour pas sur ne se ce cette avec au aux plus ou mais donc car "
    "el los las un una de del y es son que en con por para no se lo su al más o pero como cuando".split()
)
#: Kinds of tokens.
_MARK, _PLAIN, _SMALL, _NUMBER, _LINKED = range(5)
#: Printable ASCII with tabs, and the bytes of such lines with words and ends of parts only, or with words in lower case and marks only.
_PRINTABLE = bytes((*range(32, 127), 9))
_WORDS = bytes(c if chr(c).isalnum() or c == 95 else 32 for c in range(128)) + bytes(128)
_PARTED = bytes(44 if chr(c) in "|,;/>#\t" else _WORDS[c] for c in range(256))
_MARKED = bytes(44 if chr(c) in '.!?:;,|#/>()[]"\t' else _WORDS[c] for c in range(256)).lower()
_PHI = 0x9E3779B97F4A7C15
_BATCH_CHARS = 1_000_000  # characters of pages handled at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tokens(dict):
    """Numbers of the tokens of a batch of pages; what is known of a token is found out once. All marks are one token."""

    def __init__(self) -> None:
        super().__init__({"\n": 0, ",": 1})
        self.kinds = bytearray((_MARK, _MARK))

    def __missing__(self, token: str) -> int:
        self.kinds.append(_LINKED if token[0] == "@" else _SMALL if token in _FUNCTION else _NUMBER if token.isdecimal() else _PLAIN)
        self[token] = len(self)
        return len(self) - 1

    def number(self, tokens: list[str]) -> list[int]:
        return list(map(self.__getitem__, tokens))

    def small(self, numbers: list[int]) -> int:
        return bytes(map(self.kinds.__getitem__, numbers)).count(_SMALL)


# Lines of printable ASCII are parted by tables of bytes, others by the regular expressions, with the same words.


def _plain(line: str) -> bytes | None:
    """The bytes of a line of printable ASCII with the ends of clauses and parts that are no single sign as commas."""
    if not line.isascii() or (plain := line.encode()).translate(None, _PRINTABLE):
        return None
    return plain.replace(b" - ", b" , ").replace(b" -\t", b" , ").replace(b"  ", b" , ")


def _tokens(line: str) -> list[str]:
    """The words of a line in lower case, and a comma or more where a clause or an entry ends."""
    plain = _plain(line)
    if plain is None:
        return [t if t[0].isalnum() else "," for t in _TOKEN.findall(line.lower())]
    plain = plain.translate(_MARKED).replace(b",", b" , ")
    if b"_" in plain:  # it joins words only if it stands alone between them
        plain = b" %b " % plain.replace(b"__", b"  ")
        plain = plain.replace(b" _", b" ").replace(b"_ ", b" ")
    return plain.decode().split()


def _parts(line: str) -> list[str]:
    plain = _plain(line)
    return _PARTS.split(line) if plain is None else plain.translate(_PARTED).decode().split(",")


def _word_count(text: str) -> int:
    if not text.isascii():
        return len(_WORD.findall(text))
    words = text.encode().translate(_WORDS).replace(b"__", b"  ").split()
    return len(words) - words.count(b"_")


def _is_list(line: str, rest: str, words: int, links: int, numbers: list[int], known: _Tokens) -> bool:
    """Whether a line is one of links, short entries or words that are no sentence. numbers: its tokens."""
    if links and words <= 2 + 2 * links:
        return True
    stripped = rest.strip()
    if stripped[:1] == "|" and stripped[-1:] == "|" or stripped.startswith(("# ", "## ")):
        return False
    if _SENTENCE_END.search(stripped) is None and _ITEM.match(line) is None and (words <= 4 or words >= 6 and known.small(numbers) <= 0.08 * words):
        return True
    parts = _parts(rest)
    if len(parts) < 4:
        return False
    short = long = 0
    for size in map(_word_count, parts):
        short += 0 < size <= 3
        long += size > 3
        if long > 0.2 * len(parts) + 0.001:  # too many, whatever follows
            return False
    return short + long >= 4 and short >= 0.8 * (short + long)


def evidence(texts: list[str]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(list density, hashes of the distinct phrases, the share of the page's words that stand in lists in each phrase) of pages."""
    known = _Tokens()
    flat: list[int] = []
    pages, listed, weights = [], [], []  # per line: its page, whether it is listed, words of one of its links; lines end in a 0
    totals = np.zeros(len(texts))
    for page, text in enumerate(texts):
        fenced = "```" in text
        plain = _FENCE.sub("\n", text) if fenced else text
        if fenced:
            totals[page] = _word_count(text)
        for line in plain.split("\n"):
            found, rest, linked = [], line, 0
            # Every sign of a link holds one of these.
            if ("/" in line or "](" in line or "www." in line.lower()) and _LINK_SIGN.search(line):
                found = _LINK.findall(line)
                rest = _LINK.sub(" ", line)
                linked = sum(map(_word_count, found))
            numbers = known.number(_tokens(rest))
            words = len(numbers) - numbers.count(1)
            if not (words or linked):
                continue
            if not fenced:
                totals[page] += linked + words
            if found:
                sites = [m[1].lower() if (m := _SITE.search(x)) else "" for x in found]
                numbers = known.number(["@" + s for s in sites]) + numbers
            flat += numbers
            flat.append(0)
            pages.append(page)
            listed.append(_is_list(line, rest, words, len(found), numbers, known))
            weights.append(linked / len(found) if found else 0.0)
    token = np.array(flat, dtype=np.int64)
    if not len(token):
        return [(0.0, np.zeros(0, dtype=np.int64), np.zeros(0))] * len(texts)
    kind = np.frombuffer(known.kinds, dtype=np.int8)[token]
    line = np.cumsum(token == 0) - (token == 0)
    page, in_list = np.array(pages)[line], np.array(listed)[line]
    size = np.where(kind == _LINKED, np.array(weights)[line], kind != _MARK)  # words of a token
    in_list = in_list | _stuffed(token, kind, page, in_list, len(texts))[page]
    density = np.bincount(page, size * in_list, len(texts)) / np.maximum(totals, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[token]
    hashes[kind == _NUMBER] = 1
    hashes[_own(token, kind, page)] = 2
    at, phrase, share = _phrases(hashes, kind, size)
    owner, in_list = page[at], in_list[at]
    order = np.lexsort((phrase, owner))
    owner, phrase, share = owner[order], phrase[order].view(np.int64), (share * in_list)[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (phrase[1:] != phrase[:-1])
    begins = np.flatnonzero(first)
    share = np.add.reduceat(share, begins) if len(begins) else share
    ends = np.searchsorted(owner[begins], np.arange(len(texts) + 1))
    return [(float(density[k]), phrase[begins[a:b]], share[a:b] / max(totals[k], 1)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]


def _counted(token: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, token, times) of the distinct tokens of each page, and the place of each token among them."""
    key, back, times = np.unique(page << 32 | token, return_inverse=True, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, times, back


def _stuffed(token: np.ndarray, kind: np.ndarray, page: np.ndarray, in_list: np.ndarray, count: int) -> np.ndarray:
    """Pages whose sentences repeat one keyword."""
    prose = (kind != _MARK) & (kind != _LINKED) & ~in_list
    at, _, times, _ = _counted(token[prose], page[prose])
    words, distinct = np.bincount(page[prose], minlength=count), np.bincount(at, minlength=count)
    content = prose & (kind == _PLAIN)
    at, _, times, _ = _counted(token[content], page[content])
    most = np.zeros(count, dtype=np.int64)
    np.maximum.at(most, at, times)
    return (words >= 20) & (most >= KEYWORD_SHARE * words) & (distinct <= KEYWORD_DISTINCT * words)


def _own(token: np.ndarray, kind: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Places of the page's own keywords, in clauses that hold other words too."""
    content = np.flatnonzero(kind == _PLAIN)
    at, _, times, back = _counted(token[content], page[content])
    words = np.bincount(page[content], minlength=int(page.max()) + 1)
    own = content[((times >= OWN_TIMES) & (times >= OWN_SHARE * words[at]))[back]]
    clause = np.cumsum(kind == _MARK)
    other = np.ones(len(token), dtype=bool)
    other[own] = False
    return own[np.bincount(clause, other & (kind != _MARK) & (kind != _LINKED))[clause[own]] > 0]


def _phrases(hashes: np.ndarray, kind: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first word, hash, words) of every phrase: shingles of the clauses between marks, shorter clauses, links."""
    ends = (kind == _MARK) | (kind == _LINKED)
    clause = np.cumsum(ends)
    place = np.flatnonzero(~ends)
    length = np.bincount(clause[place], minlength=int(clause[-1]) + 1)[clause[place]]
    begin = np.ones(len(place), dtype=bool)
    begin[1:] = clause[place[1:]] != clause[place[:-1]]
    offset = np.arange(len(place)) - np.maximum.accumulate(np.where(begin, np.arange(len(place)), 0))
    linked = np.flatnonzero(kind == _LINKED)
    out = [(linked, hashes[linked], size[linked])]
    short = begin & (length < SHINGLE)
    for n in range(1, SHINGLE + 1):  # entries of 1 to 4 words, then shingles
        at = place[short & (length == n)] if n < SHINGLE else place[(length >= SHINGLE) & (offset <= length - SHINGLE)]
        held = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):  # the words of a clause stand side by side
            held = _mix(held * np.uint64(_PHI) + hashes[at + k])
        words = np.full(len(at), float(n)) if n < SHINGLE else (length / np.maximum(length - SHINGLE + 1, 1))[np.searchsorted(place, at)]
        out.append((at, held, words))
    return tuple(np.concatenate(x) for x in zip(*out))


def page_evidence(documents: DataFrame) -> DataFrame:
    """``doc_id, host, copy, density, phrases, shares`` of every page with text; shares only where the page may be a case."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = (batch.text.str.len().cumsum() // _BATCH_CHARS).to_numpy()
            for p in np.unique(part):
                rows = batch[part == p]
                found = evidence(rows.text.tolist())
                yield pd.DataFrame({"doc_id": rows.doc_id.to_numpy(), "host": rows.host.to_numpy(), "copy": rows["copy"].to_numpy(), "density": [d for d, _, _ in found], "phrases": [p for _, p, _ in found], "shares": [s if d >= CASE / 2 else None for d, _, s in found]})

    host = F.coalesce("origin", F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)), F.lit("")))
    pages = documents.filter("doc_id is not null and text is not null").select("doc_id", host.alias("host"), "text")
    pages = pages.select("doc_id", F.when(F.col("host").isNotNull(), F.hash("host")).alias("host"), F.xxhash64("text").alias("copy"), "text")
    return pages.mapInPandas(describe, "doc_id bigint, host int, copy bigint, density double, phrases array<bigint>, shares array<double>")


def replicated_phrases(pages: DataFrame) -> DataFrame:
    """``phrase, hosts`` of the phrases that ``HOSTS`` distinct hosts use, over all pages; a text on several hosts counts for one of them."""
    used = pages.filter("host is not null")
    copied = cut(used.groupBy("copy").agg(F.min("host").alias("one"), F.max("host").alias("b")).filter("one <> b").select("copy", "one"), "copied")
    if copied.count() <= BROADCAST_ROWS:
        copied = F.broadcast(copied)
    used = used.join(copied, "copy", "left").select(F.coalesce("one", "host").alias("host"), F.explode("phrases").alias("phrase"))
    return used.distinct().groupBy("phrase").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= HOSTS)


def find_stuffed(documents: DataFrame) -> DataFrame:
    """``doc_id, density, stitched, score`` of the pages that are cases."""
    pages = cut(page_evidence(documents), "pages")
    suspects = pages.filter(F.col("density") >= CASE / 2).select("doc_id", "density", "phrases", "shares")
    held = suspects.select("doc_id", F.explode(F.arrays_zip("phrases", "shares")).alias("x")).select("doc_id", F.col("x.phrases").alias("phrase"), F.col("x.shares").alias("share"))
    stitched = held.filter("share > 0").distinct().join(replicated_phrases(pages), "phrase").groupBy("doc_id").agg(F.sum("share").alias("stitched"))
    judged = suspects.groupBy("doc_id").agg(F.max("density").alias("density")).join(stitched, "doc_id", "left")
    scored = judged.select("doc_id", "density", F.coalesce("stitched", F.lit(0.0)).alias("stitched"), (F.col("density") + F.coalesce("stitched", F.lit(0.0))).alias("score"))
    return scored.filter(F.col("score") >= CASE)
