"""Evaluation passages inside training documents, found by an FM-index per shard.

Each shard of whole texts becomes an FM-index over its words. All runs of SEED
words of all test items are searched backwards through the wavelet ranks, their
occurrences located by sampled suffix positions. Around occurrences an exact check
extends both ways to the furthest point within the allowed differences. No text
leaves its task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spread
from .fmindex import FMIndex
from .lookalike import same_look

#: With at most one in ten of 20 or more words different, some 6 words in a row agree; seeds are shorter, for words broken beyond repair.
SEED, LEAST, ONE_IN = 4, 20, 10
#: Characters per shard, so an index stays small whatever the batch.
SHARD_CHARS = 8_000_000
#: Longer texts, in words, are searched in pieces that overlap by twice the longest item, so that each case lies in some piece.
PIECE = 1_500_000

_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
# texts are searched with a line's end before them, so that these begin with a sign to look for
# a line of name, docket and page, each between long dashes
_HEADER = re.compile(r"\n[^\n—]{2,160}—[^\n—]{2,60}— ?[^\W\d_]{1,12}\.? \d{1,5} *(?=\n|\Z)")
_BREAK = re.compile(r"-[ \n]*\n[ \n]*")
# a paragraph's number: after its sign, in brackets, or before a point or bracket where a line or sentence begins
_PARAGRAPH = re.compile(r"[¶(\[0-9](?:(?<=¶)\s*\d{1,4}(?!\w)|(?<=[(\[]) ?\d{1,4} ?[)\]]|(?:(?<=\n[0-9])|(?<=[.;:!?][ \n][0-9]))\d{0,3}[.)](?=\s|\Z))")
_HYPHEN = re.compile("-")
_MARK = re.compile(r"[^\x00-\x7f\w]")
#: What is evened out, in order: pattern, what stands for it, and a string without which it can't occur.
_STEPS = [(_HEADER, "\n", "—"), (_BREAK, "", "-"), (_PARAGRAPH, " ", ""), (_HYPHEN, "", "-"), (_MARK, " ", "")]


def words(text: str) -> list[bytes]:
    """Words in the form in which they are compared.

    Look-alikes, case, punctuation and hyphens are evened out, page headers and paragraphs' numbers go, and
    words broken at a line's end are joined. Other numbers are words like any.
    """
    text = "\n" + same_look(text).lower()
    for pattern, by, needs in _STEPS:
        if needs in text:
            text = pattern.sub(by, text) if pattern is not _HYPHEN else text.replace("-", "")
    return text.encode("utf-8", "replace").translate(_BLANK).split()


_SPAN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def traced(text: str) -> list[tuple[bytes, int, int]]:
    """words(), each with the range of the text that it came from.

    The same steps, taken sign by sign; for the few texts of which spans are cut out.
    """
    parts, at, i = ["\n"], [(0, 0)], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and (unicodedata.combining(text[j]) or not same_look(text[j])):
            j += 1
        piece = same_look(text[i:j]).lower()
        parts.append(piece)
        at += [(i, j)] * len(piece)
        i = j
    t = "".join(parts)
    for pattern, by, _ in _STEPS:
        out, kept, last = [], [], 0
        for m in pattern.finditer(t):
            out += [t[last : m.start()], by]
            kept += [*at[last : m.start()], *[(0, 0)] * len(by)]
            last = m.end()
        t, at = "".join([*out, t[last:]]), kept + at[last:]
    return [(m.group().encode("utf-8", "replace"), at[m.start()][0], at[m.end() - 1][1]) for m in _SPAN.finditer(t)]


def _reach(item: list[int], doc: list[int], i: int, j: int, most: int) -> list[tuple[int, int]]:
    """How many item words from i, and document words from j, meet with 0, 1, ... ``most`` differences, ending in one that agrees.

    Furthest-reaching points per diagonal: a difference replaces, drops or adds a word.
    """
    n, m = len(item), len(doc)

    def slide(a: int, d: int) -> int:
        b = a + d
        while i + a < n and j + b < m and item[i + a] == doc[j + b]:
            a += 1
            b += 1
        return a

    far = {0: slide(0, 0)}
    best = (far[0], far[0])
    out = [best]
    for _ in range(most):
        new: dict[int, int] = {}
        for d, a in far.items():
            for nd, na in ((d, a + 1), (d - 1, a + 1), (d + 1, a)):
                if i + na <= n and 0 <= j + na + nd <= m and na > new.get(nd, -1):
                    new[nd] = na
        far = {}
        for d, a in new.items():
            far[d] = s = slide(a, d)
            if s > a and s > best[0]:
                best = (s, s + d)
        out.append(best)
    return out


def stretch(item: list[int], doc: list[int], i: int, j: int) -> tuple[int, int] | None:
    """The longest case around the agreeing words item[i], doc[j]: (first document word, last + 1), or None."""
    most = len(item) // ONE_IN
    right = _reach(item, doc, i, j, most)
    left = _reach(item[:i][::-1], doc[:j][::-1], 0, 0, most)
    found, longest = None, LEAST - 1
    for a, (x, u) in enumerate(left):
        for b, (y, v) in enumerate(right):
            if x + y > longest and (a + b) * ONE_IN <= x + y:
                found, longest = (j - u, j + v), x + y
    return found


class Items:
    """The test items' words and seeds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        self.seeds: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
        for n, ws in enumerate(self.words):
            if len(ws) >= LEAST:
                for k in range(len(ws) - SEED + 1):
                    self.seeds[tuple(ws[k : k + SEED])].append((n, k))


def search_shard(docs: list[tuple[int, list[bytes]]], items: Items) -> list[tuple[int, int, int, int]]:
    """(doc, item, first word, last word + 1 in the document) of a shard's cases."""
    # symbols: 0 end of index, 1 end of document, 2... words
    symbols: defaultdict = defaultdict()
    symbols.default_factory = lambda: len(symbols) + 2
    parts = [np.array([symbols[w] for w in ws], dtype=np.int32) for _, ws in docs]
    starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
    text = np.ones(starts[-1], dtype=np.int32)
    for s, p in zip(starts, parts):
        text[s : s + len(p)] = p
    known = [(s, at) for s, at in items.seeds.items() if all(w in symbols for w in s)]
    if not known:
        return []
    index = FMIndex(text, len(symbols) + 2)
    which, where = index.search(np.array([[symbols[w] for w in s] for s, _ in known], dtype=np.int64))
    doc_of = np.searchsorted(starts, where, side="right") - 1
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for s, d, p in zip(which.tolist(), doc_of.tolist(), (where - starts[doc_of]).tolist()):
        for item, k in known[s][1]:
            hits[d, item].append((p, k))
    item_ids: dict[int, list[int]] = {}
    out, doc_words = [], {}
    for (d, item), at in hits.items():
        if len(at) < 2:  # 20 words with 2 differences hold 9 seeds
            continue
        if item not in item_ids:
            item_ids[item] = [symbols.get(w, -1) for w in items.words[item]]
        if d not in doc_words:
            doc_words[d] = parts[d].tolist()
        seen: set[tuple[int, int]] = set()
        for p, k in sorted(at):
            seen.add((p, k))
            if (p - 1, k - 1) in seen:  # the same run
                continue
            if found := stretch(item_ids[item], doc_words[d], k, p):
                out.append((docs[d][0], items.ids[item], *found))
    return out


def pieces(ws: list[bytes], overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of a text's pieces; short texts are one."""
    if len(ws) <= PIECE:
        yield 0, ws
        return
    for at in range(0, max(1, len(ws) - overlap), max(1, PIECE - overlap)):
        yield at, ws[at : at + PIECE]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Bytes of test items that are searched at once; more are searched in groups.
ITEM_BYTES = 64 << 20

_CASE = "doc_id bigint, item_id bigint, words array<struct<start: bigint, stop: bigint>>"
_CHARS = ", chars array<struct<start: bigint, stop: bigint>>"


def _spans(v: list[tuple[int, int]]) -> list[dict]:
    return [{"start": int(a), "stop": int(z)} for a, z in v]


def leaks(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", chars: bool = False) -> DataFrame:
    """(doc_id, item_id, words): each document with each item it carries, and the merged ranges of its words (start, stop), stop not included.

    Words are counted without page headers and paragraphs' numbers. With ``chars`` there is also ``chars``, the same as ranges of characters of the text.
    Items' size is summed first; they come to the driver in groups of about ITEM_BYTES (one item of more is a group of its own), and the
    documents are read once a group, so there may be any number of items. Null and
    empty texts carry nothing; items of fewer than LEAST words can't be cases; repeated
    documents are cases each.
    """
    items = items.select(F.col(item).alias("item"), F.col(text).alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // ITEM_BYTES))
    rows = spread(docs.select(docs[doc].alias("doc"), docs[text].alias("text")).dropna(), "doc")
    out = [_search(rows, items.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g), chars) for g in range(groups)]
    return reduce(DataFrame.unionByName, out)


def _search(docs: DataFrame, items: DataFrame, chars: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Items(shared.value)
        overlap = 2 * max(map(len, known.words), default=0)
        for b in batches:
            shard, size, found, first = [], 0, [], {}

            def close() -> None:
                found.extend((first[n][0], i, first[n][1] + a, first[n][1] + z) for n, i, a, z in search_shard(shard, known))
                shard.clear()

            for row, (d, t) in enumerate(zip(b["doc"], b["text"])):
                for at, ws in pieces(words(t), overlap):
                    n = len(first)
                    first[n] = ((row, d), at)
                    shard.append((n, ws))
                    size += min(len(t), 6 * len(ws))
                    if size >= SHARD_CHARS:
                        close()
                        size = 0
            if shard:
                close()
            by: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
            for d, i, a, z in found:
                by[d, i].append((a, z))
            if not by:
                continue
            spans = [merge(v) for v in by.values()]
            out = pd.DataFrame({"doc_id": [k[0][1] for k in by], "item_id": [k[1] for k in by], "words": [_spans(v) for v in spans]})
            if chars:
                places = {row: traced(b["text"].iloc[row]) for (row, _), _ in by}
                out["chars"] = [_spans([(places[k[0][0]][a][1], places[k[0][0]][z - 1][2]) for a, z in v]) for k, v in zip(by, spans)]
            yield out

    return docs.mapInPandas(run, _CASE + _CHARS * chars)


def removals(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_ids, chars): per document the items it carries, in order, and the ranges of characters to remove, merged over all of them.

    Of repeated documents, which share their text if they share their id, one row is made.
    """

    @F.pandas_udf("array<struct<start: bigint, stop: bigint>>")
    def merged(spans: pd.Series) -> pd.Series:
        return pd.Series([_spans(merge([(x["start"], x["stop"]) for x in v])) for v in spans], dtype=object)

    # cases are few beside the documents, and a document has no more than there are items
    by = leaks(docs, items, doc, item, text, True).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.flatten(F.collect_list("chars")).alias("all"))
    return by.select("doc_id", "item_ids", merged("all").alias("chars"))
