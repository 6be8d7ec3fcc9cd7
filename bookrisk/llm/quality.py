"""Quality classifier by co-training.

Two views of a document, each with a logistic regression: the text view sees
the whole text (shares of character classes, repetition of words and lines,
hashed character pairs), the metadata view only source, language and length
column. Both start from a bounded labelled sample. In each round a view
labels a bounded pool of unlabelled rows; what it is confident of by its
calibrated probability (``confident`` or more for either label) joins the
other view's training set. A view that knows little is never that sure after
calibration and so teaches nothing wrong. At the end both views are
calibrated on labelled rows that trained neither, and a logistic of the two
calibrated log odds gives the score of every document.

Bounds: ``labelled`` labelled and ``pool`` unlabelled rows, drawn by the hash
of the id; the model has a fixed size.

Defined results: null text counts as empty, null metadata as a level of its
own; repeated rows get equal scores; with one label or none in the sample the
score is that label's share (0.5 without labels); null ids are scored but
never train; an empty table gives an empty result; other input columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import text_slices, uniform

PAIRS = 128
STATS = 14
LEVELS = 64
_RUN = re.compile(r"(.)\1\1")


def text_features(text: str | None) -> np.ndarray:
    """Shares and hashed character pairs of a whole text."""
    text = text or ""
    out = np.zeros(STATS + PAIRS, dtype=np.float32)
    n = len(text)
    if not n:
        return out
    words = text.split()
    w = max(1, len(words))
    common = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ascii_ = c[c < 128]
    lower = int(((ascii_ >= 97) & (ascii_ <= 122)).sum()) + int((c >= 192).sum())
    upper = int(((ascii_ >= 65) & (ascii_ <= 90)).sum())
    digit = int(((ascii_ >= 48) & (ascii_ <= 57)).sum())
    space = int(((ascii_ == 32) | ((ascii_ >= 9) & (ascii_ <= 13))).sum())
    mark = n - lower - upper - digit - space
    repeated = sum(a == b for a, b in zip(words[:-1], words[1:], strict=True))
    out[:STATS] = (
        upper / n, digit / n, space / n, mark / n, np.log1p(n) / 12, np.log1p(n / w) / 3, len(common) / w,
        max(common.values(), default=0) / w, repeated / w, len(set(lines)) / max(1, len(lines)),
        len(_RUN.findall(text)) / w, sum(not x[-1].isalnum() for x in words) / w,
        sum(not any(map(str.isalnum, x)) for x in words) / w, sum(x.isupper() for x in words) / w)
    if n > 1:
        low = np.where((c >= 65) & (c <= 90), c + 32, c)
        pair = (low[:-1] * np.uint32(0x9E3779B1) ^ low[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(25)
        out[STATS:] = np.sqrt(np.bincount(pair, minlength=PAIRS) / (n - 1))
    return out


def metadata_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language levels and a length class."""
    out = np.zeros(3 * LEVELS, dtype=np.float32)
    for i, value in enumerate((source, lang)):
        key = "\0" if value is None else value
        out[i * LEVELS + xxhash.xxh32_intdigest(key.encode(), seed=i) % LEVELS] = 1.0
    length = 0 if n_chars is None else 1 + int(2 * np.log2(1 + max(0, n_chars)))
    out[2 * LEVELS + min(LEVELS - 1, length)] = 1.0
    return out


class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns;
    both labels weigh the same."""

    def __init__(self, ridge: float = 1e-2, steps: int = 12):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        penalty = self.ridge * np.r_[0.0, np.ones(x.shape[1])]
        self.beta = np.zeros(z.shape[1])
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            hess = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty + 1e-6)
            self.beta -= np.linalg.solve(hess, z.T @ (weight * (p - y)) + penalty * self.beta)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.beta[1:] + self.beta[0], -30, 30)


def _platt(logit: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Calibration (a, b, ...) of log odds columns: unweighted logistic."""
    z = np.column_stack([np.ones(len(y)), logit])
    beta = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        hess = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + 1e-2 * np.eye(z.shape[1])
        beta -= np.linalg.solve(hess, z.T @ (p - y) + 1e-2 * beta)
    return beta


def _sure(beta: np.ndarray, logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * logit, -30, 30)))


@dataclass
class Model:
    views: list[Logistic]
    calibration: list[np.ndarray]
    blend: np.ndarray
    share: float

    def scores(self, text_x: np.ndarray, meta_x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated score of either view and of both."""
        if not self.views:
            flat = np.full(len(text_x), self.share)
            return flat, flat, flat
        odds = [c[0] + c[1] * v.logit(x) for v, c, x in zip(self.views, self.calibration, (text_x, meta_x), strict=True)]
        both = self.blend[0] + self.blend[1] * odds[0] + self.blend[2] * odds[1]
        return tuple(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in (*odds, both))


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = 4,
             confident: float = 0.97, per_round: int = 400) -> Model:
    """Co-training on feature arrays; the last third of the rows calibrates."""
    share = float(y.mean()) if len(y) else 0.5
    cut = 2 * len(y) // 3
    if min(len(set(y[:cut])), len(set(y[cut:]))) < 2:
        return Model([], [], np.zeros(3), share)
    extra = [[np.empty((0, v.shape[1])), np.empty(0)] for v in views]
    left = np.ones(len(pool[0]), dtype=bool)
    for turn in range(rounds + 1):
        models = [Logistic().fit(np.vstack([v[:cut], e[0]]), np.r_[y[:cut], e[1]]) for v, e in zip(views, extra, strict=True)]
        calibration = [_platt(m.logit(v[cut:])[:, None], y[cut:]) for m, v in zip(models, views, strict=True)]
        if turn == rounds:
            break
        taken = np.zeros(len(left), dtype=bool)
        says = [_sure(calibration[i], models[i].logit(pool[i])) for i in (0, 1)]
        # rows of which the views are sure in opposite ways teach neither
        agreed = ~((np.minimum(*says) <= 1 - confident) & (np.maximum(*says) >= confident))
        for teacher, pupil in ((0, 1), (1, 0)):
            p = says[teacher]
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                pick = np.flatnonzero(left & agreed & (sure >= confident))
                pick = pick[np.argsort(-sure[pick], kind="stable")][:per_round]
                extra[pupil] = [np.vstack([extra[pupil][0], pool[pupil][pick]]), np.r_[extra[pupil][1], np.full(len(pick), label)]]
                taken[pick] = True
        left &= ~taken
    odds = np.column_stack([c[0] + c[1] * m.logit(v[cut:]) for m, c, v in zip(models, calibration, views, strict=True)])
    return Model(models, calibration, _platt(odds, y[cut:]), share)


def _view_columns(docs: DataFrame, text_col: str) -> list[Column]:
    have = set(docs.columns)
    def column(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)
    return [F.col(text_col).cast("string").alias("text"), column("source", "string"), column("lang", "string"), column("n_chars", "long")]


def train(docs: DataFrame, labels: DataFrame, labelled: int = 4000, pool: int = 3000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", **how) -> Model:
    """Fit both views on bounded draws of labelled and other rows."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id is not null and y in (0, 1)").dropDuplicates(["id"]))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rate = labelled / max(1, sum(counts.values()))
    picked = F.broadcast(known.where(uniform("id", salt="quality") < rate).limit(2 * labelled))
    rows = docs.select(F.col(id_col).alias("id"), *_view_columns(docs, text_col))
    ids = known.select("id")  # the pool holds no labelled row, also none that only calibrates
    total = rows.select("id").join(ids, "id", "left_anti").count()
    other = (rows.where(uniform("id", salt="pool") < pool / max(1, total)).join(ids, "id", "left_anti")
             .limit(2 * pool).withColumn("y", F.lit(-1)))
    sample = rows.join(picked, "id").unionByName(other)

    def features(batches):
        for b in batches:
            ids, text, source, lang, n, y = (b.column(i) for i in range(6))
            meta = zip(source.to_pylist(), lang.to_pylist(), n.to_pylist(), strict=True)
            a = [text_features(t).tolist() for part in text_slices(text) for t in part]
            yield pa.record_batch([ids, y, pa.array(a, pa.list_(pa.float32())),
                                   pa.array([metadata_features(*m).tolist() for m in meta], pa.list_(pa.float32()))],
                                  names=["id", "y", "a", "b"])
    got = sample.select(F.col("id").cast("string").alias("id"), "text", "source", "lang", "n_chars", "y").mapInArrow(
        features, "id string, y int, a array<float>, b array<float>").collect()
    got.sort(key=lambda r: xxhash.xxh64_intdigest(r["id"] or "", seed=7))
    use, rest = [r for r in got if r["y"] >= 0], [r for r in got if r["y"] < 0]
    def arrays(rows, name: str, width: int) -> np.ndarray:
        return np.array([r[name] for r in rows], dtype=np.float64).reshape(len(rows), width)
    sizes = (("a", STATS + PAIRS), ("b", 3 * LEVELS))
    return co_train([arrays(use, *s) for s in sizes], np.array([r["y"] for r in use], dtype=np.float64),
                    [arrays(rest, *s) for s in sizes], **how)


def scorer(spark, model: Model):
    """A column function (text, source, lang, n_chars) -> struct of scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<text_score: double, meta_score: double, score: double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, source, lang, n in batches:
            a = np.array([text_features(t) for part in text_slices(text) for t in part]).reshape(len(text), STATS + PAIRS)
            meta = zip(source.to_pylist(), lang.to_pylist(), n.to_pylist(), strict=True)
            b = np.array([metadata_features(*m) for m in meta]).reshape(len(text), 3 * LEVELS)
            scores = shared.value.scores(a, b)
            yield pa.StructArray.from_arrays([pa.array(s, pa.float64()) for s in scores], names=["text_score", "meta_score", "score"])
    return run.asNondeterministic()  # evaluated once, not again for each use


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The struct of scores as a column of ``docs``."""
    return scorer(docs.sparkSession, model)(*[c for c in _view_columns(docs, text_col)])


def score(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep), one row per input row."""
    return (docs.select(F.col(id_col).alias("doc_id"), scored(docs, model, text_col).alias("s")).select("doc_id", "s.*")
            .withColumn("keep", F.col("score") >= threshold))
