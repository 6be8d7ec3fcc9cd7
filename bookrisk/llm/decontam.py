"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words joined by single spaces,
so that case, punctuation, line breaks, the form of composed letters (NFKC)
and invisible format characters do not matter. An item of n
characters may differ by up to k = n // ``chars_per_edit`` insertions,
deletions or replacements. It is cut into k + 1 pieces: k edits leave at
least one piece untouched, so every occurrence holds an exact piece at, give
or take k, its place. One Aho-Corasick automaton over all pieces finds the
hits; the window around a hit is verified with Myers' bit-parallel distance.
Items of fewer than ``min_chars`` characters may not differ: they are sought
as they are, between word borders (scripts without spaces have a border at
every character).

The items are the query set: they are read in blocks of at most
``block_bytes`` of text (pieces and automaton grow with the block only), and
every block is matched against all documents.

Defined results: documents with null or empty text match nothing; items that
are null, or empty once normalised, match nothing; items with equal normalised text are all reported; repeated
documents get equal rows; null ids stay null; empty tables give an empty
result; other input columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import text_slices

#: Characters without a shape of their own: soft hyphen, zero-width and direction marks.
_FORMAT = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_WORDS = re.compile(r"[^\W_]+")
#: Thai to Khmer, kana, Chinese characters.
_SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
CHARS_PER_EDIT = 16
MIN_CHARS = 24
MATCH = "doc_id long, item_id long, edits int, start int, length int"


def normalise(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower()
    return " ".join(_WORDS.findall(text))


def border(text: str, at: int) -> bool:
    """Whether a word may begin or end before the character at ``at``."""
    return at <= 0 or at >= len(text) or " " in text[at - 1:at + 1] or _SPACELESS.search(text[at - 1:at + 1]) is not None


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """Least edits of ``pattern`` against any part of ``text`` and where that
    part ends (the first best), or None if above ``limit``."""
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        peq[ch] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, limit + 1, -1
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j
    return (best, at) if best <= limit else None


class Matcher:
    """Finds the items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS):
        self.items = [(i, t, len(t) // chars_per_edit if len(t) >= min_chars else 0) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.short = [len(t) < min_chars for _, t, _ in self.items]
        places = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            cut = [len(t) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                places[t[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, length) of the best occurrence of each item."""
        if not len(self.automaton):
            return []
        starts = defaultdict(set)  # where an item would begin
        for end, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                starts[n].add(end - size + 1 - offset)
        out = []
        for n, where in starts.items():
            item, pattern, k = self.items[n]
            best, checked = None, None
            for s in sorted(where):
                if self.short[n]:
                    if border(text, s) and border(text, s + len(pattern)):
                        best = (0, s, len(pattern))
                        break
                    continue
                lo, hi = max(0, s - k), min(len(text), s + len(pattern) + k)
                if checked and lo >= checked[0] and hi <= checked[1]:
                    continue
                checked = (lo, hi)
                exact = text.startswith(pattern, s) if s >= 0 else False
                found = (0, s + len(pattern) - 1 - lo) if exact else myers(pattern, text[lo:hi], k)
                if found and (best is None or found[0] < best[0]):
                    back = (found[0], len(pattern) - 1) if exact else myers(pattern[::-1], text[max(0, lo + found[1] + 1 - len(pattern) - k):lo + found[1] + 1][::-1], k)
                    length = back[1] + 1
                    best = (found[0], lo + found[1] + 1 - length, length)
                if best and best[0] == 0:
                    break
            if best:
                out.append((item, *best))
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int, item_col: str = "item_id", text_col: str = "text") -> list[list]:
    """The items (id, text) in blocks of about ``block_bytes`` of text."""
    blocks, size = [[]], 0
    rows = benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        if size >= block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((item, text))
        size += len(text)
    return blocks


def matches(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS,
            block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, length), one row per document and item
    found, with the best occurrence in the normalised text."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def against(items):
        shared = spark.sparkContext.broadcast(items)

        def run(batches):
            matcher = Matcher(shared.value, chars_per_edit, min_chars)
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                texts = (t for part in text_slices(b.column(1)) for t in part)
                for doc, t in zip(ids, texts, strict=True):
                    rows += [(doc, *m) for m in matcher.find(normalise(t))]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.int64() if i < 2 else pa.int32()) for i, c in enumerate(zip(*rows, strict=True))],
                                          names=["doc_id", "item_id", "edits", "start", "length"])
        return src.mapInArrow(run, MATCH)

    return reduce(DataFrame.unionByName, [against(items) for items in item_blocks(benchmark, block_bytes, item_col, item_text_col)])


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, min_chars: int = MIN_CHARS,
          block_bytes: int = 4 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns kept. Rows
    are judged by their own text: repeated ids and null ids do no harm."""
    spark = docs.sparkSession

    def hit(items):
        shared = spark.sparkContext.broadcast(items)

        @F.arrow_udf("boolean")
        def run(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
            matcher = Matcher(shared.value, chars_per_edit, min_chars)
            for v in values:
                yield pa.array([bool(matcher.find(normalise(t))) for part in text_slices(v) for t in part], pa.bool_())
        return run.asNondeterministic()

    out = docs
    for items in item_blocks(benchmark, block_bytes):
        out = out.where(~hit(items)(F.col(text_col).cast("string")))
    return out
