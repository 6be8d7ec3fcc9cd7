"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms replaced, Cyrillic and Greek
homoglyphs and digits or signs inside words mapped to the Latin letters they
imitate, zero-width characters dropped, everything but letters turned into
single spaces. Accents tell words apart in many languages and stay; a second
pass without accents looks for unaccented whole words only. A lexicon entry is a whole word (" word ") or a word
beginning (" begin"), with a weight. One automaton over the whole folded text
finds entries and exception phrases; an entry inside an exception phrase does
not count, and a word counts once with its heaviest entry. The score is a
logistic function of the weight found per word of text and of the number of
hits, so that long texts are not toxic by length alone.

Training reads a bounded sample of labelled rows (``per_class``
toxic and twice as many others): the weight of an entry is the lower bound
(one-sided, ``z`` standard errors) of its smoothed log odds between toxic and
other documents, so that a rare word needs no clean occurrence and a frequent
one may have some. Entries are kept from ``min_docs`` toxic documents and
``min_weight`` on, at most ``max_entries`` of the heaviest; the logistic then
weighs them. An exception is a two-word phrase around an entry that occurs in
``clean_docs`` other documents and in no toxic one. A few general words start
with the weight ``PRIOR_WEIGHT``, so that the operator also works without
labels.

Defined results: null, empty or wordless text has no hit and the score of a
text without hits; repeated rows get equal rows; with no labels the prior
lexicon and a fixed logistic are used; null labels and null ids do not
train, a null doc_id stays null; an empty table gives an empty result; other
input columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import WORD_SPACE, durable, let, text_slices, uniform

# ---- fixed values: words with a prior, look-alike letters, digit substitutions
PRIOR_WORDS = ("bastard", "disgusting", "dumbass", "idiot", "imbecile", "loser", "moron", "pathetic", "scum",
               "stupid", "worthless")
PRIOR_WEIGHT = 4.4
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
              "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
              "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
              "υ": "u", "χ": "x", "ω": "w", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍‎‏⁠﻿"
# ----
_TABLE = str.maketrans(HOMOGLYPHS | dict.fromkeys(INVISIBLE, ""))
_DIGIT_WORD = re.compile(r"(?<![^\W_])[@$!|]?[^\W_]*(?:[@$!|](?=[^\W\d_])[^\W_]*)+|[^\W_]*[0-9][^\W_]*")
_HAS_SIGN = re.compile(r"[0-9@$!|]")
_DIGIT_TABLE = str.maketrans(DIGITS)
_NOT_LETTER = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def _unmask(m: re.Match) -> str:
    word = m.group()
    return word.translate(_DIGIT_TABLE) if _LETTER.search(word) else word


def fold(text: str | None) -> str:
    """Folded words between single spaces, with a space at either end."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_TABLE)
    if _HAS_SIGN.search(text):
        text = _DIGIT_WORD.sub(_unmask, text)
    return " " + _NOT_LETTER.sub(" ", text).strip() + " "


class _Plain(dict):
    """Letter -> the letter without accents, found when first asked for."""

    def __missing__(self, code: int) -> int:
        base = unicodedata.normalize("NFD", chr(code))[0]
        self[code] = ord(base)
        return self[code]


_PLAIN = _Plain()


@dataclass
class Model:
    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    per_word: float = 1.5
    per_hit: float = 1.0
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            for entry, weight in self.entries.items():
                if entry not in a:
                    a.add_word(entry, (len(entry), weight))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def hits(self, folded: str) -> dict[int, float]:
        """Weight by the place of the word's leading space."""
        a = self.automaton()
        if not len(a):
            return {}
        found, spared = {}, []
        for end, (size, weight) in a.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        if not folded.isascii():
            for end, (size, weight) in a.iter(folded.translate(_PLAIN)):
                start = end - size + 1
                if weight is not None and size > 4 and folded[end] == " " and weight > found.get(start, 0.0):
                    found[start] = weight
        for s, e in spared:
            for at in [x for x in found if s <= x < e]:
                del found[at]
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        found = self.hits(folded)
        words = max(20, folded.count(" ") - 1)
        return float(np.log1p(1000.0 * sum(found.values()) / words)), float(np.log1p(len(found)))

    def score(self, text: str | None) -> float:
        x, n = self.features(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + self.per_word * x + self.per_hit * n, -30, 30))))


def entries_of(folded: str, lengths=(3, 4, 5, 6, 7, 8)) -> set[str]:
    """Candidate entries of a text: its words and their beginnings."""
    words = {w for w in folded.split() if len(w) >= 3}
    return {f" {w} " for w in words if len(w) <= 24} | {" " + w[:n] for w in words for n in lengths if len(w) >= n}


def _copy_key(text: Column) -> Column:
    """The smallest hash of a text's five-word shingles: equal for copies and
    for most near copies, so that one text copied often trains once."""
    def key(words: Column) -> Column:
        last = F.greatest(F.size(words) - 5, F.lit(0))
        return F.array_min(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, 5))))
    return F.coalesce(let(F.split(F.trim(F.lower(text)), WORD_SPACE), key), F.lit(0))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic): about ``per_class`` toxic and twice as many other rows,
    by the hash of the id; never more than twice that. Where labels of one id
    differ it counts as toxic; of near copies with one label the least text stays."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, per_class / max(1, counts.get(1, 0))).otherwise(2 * per_class / max(1, counts.get(0, 0)))
    draw = uniform("id", salt="toxicity")
    picked = known.where(draw < rate).orderBy(draw / rate, "id").limit(6 * per_class)
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .join(F.broadcast(picked), "id").withColumn("copy", _copy_key(F.col("text")))
            .groupBy("copy", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))


def bounded_weight(t: int, n: int, toxic: int, other: int, z: float) -> tuple[float, float]:
    """Smoothed log odds of a term in t of the toxic and n of the other
    documents, and their lower bound."""
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (other + 1))
    return float(odds), float(odds - z * np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, min_docs: int = 3, min_weight: float = 1.7,
          max_entries: int = 20000, z: float = 1.645, clean_docs: int = 8, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Lexicon, exceptions and logistic from a bounded labelled sample."""
    sample = durable(_sample(docs, labels, per_class, id_col, text_col, label_col))  # read once, used three times

    def counted(of):
        def run(batches):
            for b in batches:
                seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
                rows = Counter()
                toxic = b.column(1).to_pylist()
                for i, text in enumerate(t for part in text_slices(b.column(0)) for t in part):
                    rows[toxic[i]] += 1
                    seen[toxic[i]].update(of(fold(text)))
                terms = set(seen[0]) | set(seen[1])
                out = [("", rows[1], rows[0])] + [(t, seen[1][t], seen[0][t]) for t in terms]
                yield pa.record_batch([pa.array(x) for x in zip(*out, strict=True)], names=["term", "t", "n"])
        return sample.mapInArrow(run, "term string, t long, n long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))

    words = [f" {w} " for w in PRIOR_WORDS]
    total = durable(counted(entries_of).where((F.col("term") == "") | (F.col("t") >= min_docs) | F.col("term").isin(words)))
    size = next(((r["t"], r["n"]) for r in total.where("term = ''").collect()), (0, 0))
    t, n = F.col("t") + 0.5, F.col("n") + 0.5
    lower = F.log(t / (size[0] + 1)) - F.log(n / (size[1] + 1)) - z * F.sqrt(1 / t + 1 / n)
    kept = total.where(F.col("term") != "").where((lower >= min_weight) | F.col("term").isin(words))
    entries = dict.fromkeys(words, PRIOR_WEIGHT)
    for r in kept.orderBy(F.desc(lower), "term").limit(max_entries).collect():
        odds, weight = bounded_weight(r["t"], r["n"], *size, z)
        if r["t"] >= min_docs and weight >= min_weight:
            entries[r["term"]] = weight
        elif odds < 0:
            entries.pop(r["term"], None)
    model = Model(entries)
    if not size[0] or not size[1]:
        return model

    def phrases(folded: str) -> set[str]:
        out = set()
        for at in model.hits(folded):
            word_end = folded.index(" ", at + 1)
            next_end = folded.find(" ", word_end + 1)
            before = folded.rfind(" ", 0, at) if at else -1
            out |= {folded[at:next_end + 1]} if next_end > 0 else set()
            out |= {folded[before:word_end + 1]} if before >= 0 else set()
        return out

    spared = counted(phrases).where(f"term != '' and n >= {clean_docs} and t = 0").orderBy(F.desc("n"), "term").limit(max_entries).collect()
    model = Model(entries, [r["term"] for r in spared])

    def features(batches):
        for b in batches:
            f = [model.features(t) for part in text_slices(b.column(0)) for t in part]
            yield pa.record_batch([pa.array([x for x, _ in f], pa.float64()), pa.array([n for _, n in f], pa.float64()), b.column(1)],
                                  names=["x", "n", "toxic"])
    rows = sample.mapInArrow(features, "x double, n double, toxic int").collect()
    model.bias, model.per_word, model.per_hit = _logistic(np.array(rows, dtype=np.float64))
    return model


def _logistic(rows: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float, float]:
    """Newton steps on rows (x, n, label), classes weighted alike; slopes stay non-negative."""
    y = rows[:, 2]
    x = np.column_stack([np.ones(len(rows)), rows[:, :2]])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * np.array([0, 1, 1]) * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(3)
        beta = beta - np.linalg.solve(hess, grad)
    return float(beta[0]), max(0.0, float(beta[1])), max(0.0, float(beta[2]))


def scorer(spark, model: Model):
    """A column function text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([shared.value.score(t) for part in text_slices(values) for t in part], pa.float64())
    return run.asNondeterministic()  # evaluated once, not again for each use


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted), one row per input row."""
    s = scorer(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return (docs.select(F.col(id_col).alias("doc_id"), s.alias("score"))
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
