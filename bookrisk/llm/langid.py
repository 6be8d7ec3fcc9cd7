"""Language identification with string kernels.

A text is the set of character n-grams of lengths 1 to 3 (the blended
spectrum, presence only) over its lower-cased letters, every other run of
characters being one space. Two texts compare by the number of shared
n-grams over the root of the product of their set sizes. Training takes a
bounded sample per language, chooses landmarks from it (Nyström) and fits one
kernel ridge regression per language against the rest:
``(C'C + ridge n W) a = C'y`` with C the sample-by-landmark and W the
landmark-by-landmark kernel. Since the kernel is linear in a text's presence
vector, the landmarks and coefficients fold into one n-gram-by-language
matrix, and a batch of texts is scored by one product of its presence matrix
with it.

n-grams are hashed into 2^18 cells. Bounds: at most ``per_language`` sample
rows and ``landmarks`` landmarks per language; the model grows with the number
of languages, every one of which is learned, not with the corpus.

Defined results: null text or text without a letter gives ``und`` and score
0; with no usable training row every text is ``und``; ties go to the language
first in code-point order; repeated texts get equal rows; a null doc_id stays
null and is never held out unless its crc is (null counts as crc 0); an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import text_slices, uniform

CELLS = 1 << 18
PIECE = 1 << 20
UNKNOWN = "und"
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def spectrum(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct cells of a text's n-grams; ``seen`` is a zeroed bool array
    of CELLS entries, left zeroed. Long texts go through in pieces."""
    text, letters, any_letter = (text or ""), _letter_table(), False
    for start in range(0, len(text), PIECE):
        c = np.frombuffer(text[max(0, start - 2):start + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = letters[c]
        any_letter |= bool(is_letter.any())
        c = np.where(is_letter, c, np.uint32(32))
        c = c[is_letter | np.concatenate([[True], is_letter[:-1]])]
        one = c * np.uint32(0x9E3779B1)
        two = one[:-1] * np.uint32(31) + one[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(37) + one[2:] * np.uint32(0xC2B2AE35)
        for codes in (one, two, three):
            seen[codes >> np.uint32(14)] = True
    cells = np.flatnonzero(seen).astype(np.int32)
    seen[cells] = False
    return cells if any_letter else cells[:0]


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray   # cell -> column of the presence matrix, -1 if no landmark has it
    weights: np.ndarray  # column x language


def _kernel(sets: list[np.ndarray], landmarks: np.ndarray, column: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.empty((len(sets), len(landmarks)), dtype=np.float32)
    for s in range(0, len(sets), 64):
        part = sets[s:s + 64]
        out[s:s + 64] = presence(part, column, landmarks.shape[1]) @ landmarks.T
        out[s:s + 64] /= np.sqrt(np.array([max(1, len(x)) for x in part], dtype=np.float32))[:, None] * sizes[None, :]
    return out


def presence(sets: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    m = np.zeros((len(sets), width + 1), dtype=np.float32)
    for i, cells in enumerate(sets):
        m[i, column[cells]] = 1.0
    return m[:, :width]  # the last column gathers the cells of no landmark


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = 64, ridge: float = 1e-4) -> Model:
    """Nyström kernel ridge regression on presence sets; the first
    ``landmarks`` rows of each language are its landmarks."""
    languages = sorted(set(labels))
    picked = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:landmarks]]
    used = np.unique(np.concatenate([sets[i] for i in picked])) if picked else np.empty(0, np.int32)
    column = np.full(CELLS, -1, dtype=np.int32)
    column[used] = np.arange(len(used), dtype=np.int32)
    marks = presence([sets[i] for i in picked], column, len(used))
    sizes = np.sqrt(np.maximum(1, marks.sum(axis=1)))
    c = _kernel(sets, marks, column, sizes).astype(np.float64)
    w = c[picked]
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in labels]).reshape(len(labels), len(languages))
    alpha = np.linalg.lstsq(c.T @ c + ridge * len(labels) * w + 1e-9 * np.eye(len(picked)), c.T @ y, rcond=None)[0]
    return Model(languages, column, (marks / sizes[:, None]).T @ alpha.astype(np.float32))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None,
          per_language: int = 300, landmarks: int = 64) -> Model:
    """Fit on a bounded sample of the rows that have a language. ``key``: the
    column by whose hash the sample is drawn (default: the text)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                       uniform(key if key is not None else text_col, salt="langid").alias("u")).where("lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model([], np.full(CELLS, -1, dtype=np.int32), np.zeros((0, 0), dtype=np.float32))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(per_language / r["count"]))])

    def cells(batches):
        seen = np.zeros(CELLS, dtype=bool)
        for b in batches:
            found = [spectrum(t, seen) for part in text_slices(b.column(1)) for t in part]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(found, type=pa.list_(pa.int32()))],
                                  names=["lang", "u", "cells"])
    # the draw keeps about per_language rows of each language; the limit holds even if the draws are uneven
    sample = (rows.where(F.col("u") < F.try_element_at(share, F.col("lang"))).mapInArrow(cells, "lang string, u double, cells array<int>")
              .where("size(cells) > 0").limit(2 * per_language * len(counts)).collect())
    sample.sort(key=lambda r: (r["u"], r["lang"]))
    return fit([np.array(r["cells"], dtype=np.int32) for r in sample], [r["lang"] for r in sample], landmarks)


def predict(model: Model, texts: list[str | None], seen: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of a batch: a soft maximum of the regressions."""
    sets = [spectrum(t, seen) for t in texts]
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    f = presence(sets, model.column, len(model.weights)) @ model.weights
    f /= np.sqrt(np.array([max(1, len(s)) for s in sets], dtype=np.float32))[:, None]
    e = np.exp(4.0 * (f - f.max(axis=1, keepdims=True)))
    best = f.argmax(axis=1)
    empty = np.array([len(s) == 0 for s in sets], dtype=bool)
    score = np.where(empty, 0.0, e[np.arange(len(sets)), best] / e.sum(axis=1))
    return [UNKNOWN if z else model.languages[b] for z, b in zip(empty, best, strict=True)], score


def predictor(spark, model: Model):
    """A column function text -> struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = np.zeros(CELLS, dtype=bool)
        for values in batches:
            langs, scores = [], []
            for part in text_slices(values, 64):
                names, s = predict(shared.value, part, seen)
                langs += names
                scores.append(s)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()),
                                              pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())],
                                             names=["lang", "score"])
    return run.asNondeterministic()  # evaluated once, not again for each use


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), one row per input row."""
    p = predictor(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return (docs.select(F.col(id_col).alias("doc_id"), p.alias("p"))
            .select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))
