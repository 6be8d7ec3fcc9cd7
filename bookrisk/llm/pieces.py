"""SentencePiece encoding and decoding by a prefix table.

A byte-pair vocabulary gives every prefix of a text one last token: the
encoding of a prefix is the encoding of what stands before that token, then
the token. So a table with one entry per character, the last token of the
prefix that ends there, holds the encodings of all prefixes. An Aho-Corasick
automaton over the pieces lists the tokens that end at a character; the right
one is the one that is compatible with the last token of the prefix before
it, that is, no merge would have joined the two sides. The ids are recovered
from the table backwards. Time and memory are linear in the text.

Two tokens are compatible if, going back through the merges that built their
touching ends (latest first), no pair across the border was a piece of an
earlier merge. Merges come by score, then from the left.

A space mark (U+2581) that follows another character starts a new stretch if
no piece holds such a mark inside; so does a control character that no piece
holds. Stretches are encoded apart, and those of up to ``SHORT`` characters
are remembered by a worker, ``REMEMBER`` at a time, as are the verdicts on
``PAIRS`` pairs of tokens; these bounds and ``WINDOW`` only affect speed and memory.

Defined results: null and empty texts have no tokens and decode to the empty
text; texts of any length are encoded whole; rows are independent of each
other, so ties and repeats give equal results; characters outside the
vocabulary become byte tokens; other columns are kept. Only byte-pair models
that keep the text as it is (identity normaliser, mark before the text, no
user-defined pieces, byte fallback) are accepted; others raise ValueError.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookrisk.llm.common import text_slices

MARK = "▁"
SHORT = 48
REMEMBER = 150_000
PAIRS = 200_000
#: Characters that are cut into stretches at a time.
WINDOW = 1 << 18
UNKNOWN_SURFACE = " ⁇ "
#: Kinds of ids that matter to decoding: without a text, beginning with the mark.
CONTROL, MARKED = 1, 2


codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def _text(surface: bytes | None, whole: bool) -> str:
    """The text of joined surfaces; without ``whole`` a leading space goes."""
    text = (surface or b"").decode("utf-8", "each_byte")
    return text if whole or text[:1] != " " else text[1:]


@dataclass(frozen=True)
class Vocabulary:
    """Text pieces with their ids and ranks (0: merged first; equal scores
    share a rank), the ids of the 256 bytes, and the bytes of every id."""

    pieces: dict[str, int]
    rank: list[int]
    byte_ids: list[int]
    surface: list[bytes]

    @cached_property
    def text(self) -> list[str]:
        out = [""] * len(self.surface)
        for p, i in self.pieces.items():
            out[i] = p
        return out

    @cached_property
    def size(self) -> list[int]:
        return [len(p) for p in self.text]

    @cached_property
    def judged(self) -> dict[int, bool]:
        """Verdicts on pairs of tokens; started anew at ``PAIRS``."""
        return {}

    @cached_property
    def split(self) -> list[tuple[int, int] | None]:
        """The pieces whose merge makes a piece; None for one character, and
        the piece itself twice if merging its characters does not lead to it."""
        out: list[tuple[int, int] | None] = [None] * len(self.surface)
        for p, i in self.pieces.items():
            if len(p) > 1:
                parts, last = list(p), None
                while len(parts) > 1 and (best := self.best(parts)) is not None:
                    last = (parts[best], parts[best + 1])
                    parts[best:best + 2] = [parts[best] + parts[best + 1]]
                out[i] = (self.pieces[last[0]], self.pieces[last[1]]) if len(parts) == 1 and last else (i, i)
        return out

    def best(self, parts: list[str]) -> int | None:
        """Where the next merge takes place: best rank, then leftmost."""
        ranked = [(self.rank[i], k) for k in range(len(parts) - 1) if (i := self.pieces.get(parts[k] + parts[k + 1])) is not None]
        return min(ranked)[1] if ranked else None

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p, i in self.pieces.items():
            if self.split[i] != (i, i):
                a.add_word(p, (i, len(p)))
        a.make_automaton()
        return a

    @cached_property
    def encoder(self) -> Encoder:
        """Kept with the broadcast value, so a worker's next tasks use it too."""
        return Encoder(self)

    @cached_property
    def inner_mark(self) -> bool:
        return any(MARK in p.lstrip(MARK) for p in self.pieces)

    @cached_property
    def cut(self) -> re.Pattern:
        """Two characters between which no merge takes place."""
        return re.compile("(?!)" if self.inner_mark else f"[^{MARK}]{MARK}")

    @cached_property
    def stretch(self) -> re.Pattern:
        """Parts of a text across whose borders no merge takes place."""
        if self.inner_mark:
            return re.compile(r"(?s).+")
        held = {c for p in self.pieces if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in held)
        return re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens ``a`` and ``b``."""
        text, rank, split, pieces = self.text, self.rank, self.split, self.pieces
        limit = 1 << 60  # a merge across the border must come before this one to count
        while True:
            joined = pieces.get(text[a] + text[b])
            if joined is not None and rank[joined] < limit:
                return False
            sa, sb = split[a], split[b]
            if sa is None and sb is None:
                return True
            if sb is None or sa is not None and rank[a] > rank[b]:
                limit, a = rank[a], sa[1]  # of equal ranks the left merge comes first
            else:
                limit, b = rank[b] + 1, sb[0]

    def encode_stretch(self, s: str) -> bytes:
        """Ids of a stretch as 32-bit integers."""
        last = array("i", [-1]) * (len(s) + 1) if len(s) > SHORT else [-1] * (len(s) + 1)
        judged, many, found = self.judged, len(self.rank), 0
        for end, (i, size) in self.automaton.iter(s):
            if end < found:
                continue
            before = last[end + 1 - size]  # -1 before the text and after a character in no piece
            if before >= 0:
                pair = before * many + i
                try:
                    fits = judged[pair]
                except KeyError:
                    if len(judged) >= PAIRS:
                        judged.clear()
                    fits = judged[pair] = self.compatible(before, i)
                if not fits:
                    continue
            last[end + 1] = i
            found = end + 1
        ids, at, size = [], len(s), self.size
        while at:
            i = last[at]
            if i < 0:  # in no piece
                ids += [self.byte_ids[x] for x in reversed(s[at - 1].encode())]
                at -= 1
            else:
                ids.append(i)
                at -= size[i]
        ids.reverse()
        return array("i", ids).tobytes()


def vocabulary(path: str) -> Vocabulary:
    """Read the pieces of a model file."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = proto.ModelProto.SentencePiece
    n, t = model.normalizer_spec, model.trainer_spec
    if (t.model_type != proto.TrainerSpec.BPE or not t.byte_fallback or t.treat_whitespace_as_suffix or n.precompiled_charsmap
            or not n.add_dummy_prefix or not n.escape_whitespaces or n.remove_extra_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
        raise ValueError("a byte-pair model with identity normaliser and byte fallback is needed")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
    order = {s: r for r, s in enumerate(sorted({p.score for p in model.pieces if p.type == kinds.NORMAL}, reverse=True))}
    rank = [order.get(p.score, 0) if p.type == kinds.NORMAL else 0 for p in model.pieces]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    surface = [p.piece.replace(MARK, " ").encode() if p.type == kinds.NORMAL else b"" for p in model.pieces]
    for b, i in enumerate(byte_ids):
        surface[i] = bytes([b])
    surface[sp.unk_id()] = UNKNOWN_SURFACE.encode()
    return Vocabulary(pieces, rank, byte_ids, surface)


class Encoder:
    """Encodes texts with a memory of short stretches: two generations of at
    most ``REMEMBER`` each, so what recurs stays and memory is bounded."""

    def __init__(self, v: Vocabulary):
        self.v, self.young, self.old = v, {}, {}

    def windows(self, text: str) -> Iterator[str]:
        """The marked text in parts of ``WINDOW`` characters, or more where
        there is no place to cut."""
        text, at = MARK + text.replace(" ", MARK), 0
        while at < len(text):
            cut = self.v.cut.search(text, at + WINDOW)
            end = cut.start() + 1 if cut else len(text)
            yield text[at:end]
            at = end

    def ids(self, text: str | None) -> bytes:
        """Ids of a text as 32-bit integers."""
        out, young = [], self.young
        for w in self.windows(text) if text else ():
            for s in self.v.stretch.findall(w):
                x = young.get(s)
                if x is None:
                    x = self.old.get(s) or self.v.encode_stretch(s)
                    if len(s) <= SHORT:
                        young[s] = x
                        if len(young) >= REMEMBER:
                            self.old, self.young = young, {}
                            young = self.young
                out.append(x)
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and end."""
        found = [self.ids(t) for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        return pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))]), ends


@dataclass(frozen=True)
class Decoder:
    """Bytes and kinds of all ids."""

    surface: pa.Array
    kind: np.ndarray

    @classmethod
    def of(cls, v: Vocabulary) -> Decoder:
        kind = [CONTROL if not x else MARKED if p[:1] == MARK else 0 for x, p in zip(v.surface, v.text, strict=True)]
        return cls(pa.array(v.surface, pa.binary()), np.array(kind))

    def decode(self, ids: pa.Array, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids, which lie one after the other."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.surface.take(ids)), b"").to_pylist()
        kind = self.kind[ids]
        shown = np.where(kind == CONTROL, len(ids), np.arange(len(ids)))
        first = np.append(np.minimum.accumulate(shown[::-1])[::-1], len(ids))[ends[:-1]]  # what starts each text, or a later one
        return [_text(x, k != MARKED) for x, k in zip(joined, np.append(kind, CONTROL)[first], strict=True)]


def decoder(spark: SparkSession, v: Vocabulary):
    """A column function array of ids -> text. A run of byte tokens is read as
    UTF-8, each wrong byte as U+FFFD; control ids and nulls are passed over; the
    mark before the text goes."""
    shared = spark.sparkContext.broadcast(v)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        d = Decoder.of(shared.value)
        for values in batches:
            starts = values.offsets.to_numpy()
            yield pa.array(d.decode(values.flatten(), starts - starts[0]), pa.string())
    return lambda ids: run(F.coalesce(F.array_compact(ids), F.array().cast("array<int>")))


def round_trip(docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, d = shared.value.encoder, Decoder.of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids, ends = e.encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids),
                                       pa.array(d.decode(ids, ends), pa.string())], names=["doc_id", "ids", "decoded"])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
