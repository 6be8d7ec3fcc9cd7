"""Sketches against plain Python; the order of sparse, equal and null ids."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from bookrisk.llm import sketch as S

WORDS = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in "lmnrst"]
DOC = "doc_id long, text string"


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def fold(parts):
    """XXH64 of an array as Spark chains it: each element seeds the next."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def plain(text):
    low = (text or "").lower()
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    letters = re.sub(r"[\x20\x09-\x0D]+", " ", low)

    def kept(parts):
        return sorted({h for i in range(max(1, len(parts) - 4)) if (h := fold(parts[i:i + 5])) < -(1 << 63) + (1 << 62)}) if parts else []
    return kept(words), kept(list(letters)) if 0 < len(words) < S.SHORT else []


def alike(a, b, same):
    use = (0, 1) if a[1] and b[1] else (0,)
    least = min(sum(len(x[i]) for i in use) for x in (a, b))
    return sum(len(set(a[i]) & set(b[i])) for i in use) / least if least else float(same)


def text_of(s):
    w, c = ("".join(f"{h & (1 << 64) - 1:016x}" for h in x) for x in s)
    return w + (":" + c if c else "")


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, fold([r[1] or ""])), reverse=True)
    out = []
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + nxt[:third]
        a, e = plain(t), plain(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(e), alike(a, e, t == edited), alike(a, plain(nxt), t == nxt)))
    return sorted(out, key=str)


def compare(spark, rows):
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("block", "sk", "top", "of", "edited")}).repartition(5)
    assert sorted(map(tuple, S.compare_edits(df).collect()), key=str) == expected(rows)


@pytest.mark.parametrize("ids", ["dense", "sparse", "outlier", "equal", "null", "mixed"])
def test_all_columns_equal_plain_rows(spark, monkeypatch, ids):
    monkeypatch.setattr(S, "BLOCK", 8)
    r = random.Random(5)
    draw = {"dense": lambda i: i, "sparse": lambda i: r.getrandbits(62) - (1 << 61), "outlier": lambda i: i if i else 1 << 60,
            "equal": lambda i: 7 if i % 2 else i, "null": lambda i: None if i % 2 else i, "mixed": lambda i: r.choice([None, 5, -3, i * 1000])}[ids]
    rows = [(draw(i), prose(r, r.choice([1, 3, 8, 20, 63, 64, 65, 120]))) for i in range(130)]
    compare(spark, rows)


def test_edge_texts(spark):
    r = random.Random(6)
    compare(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, "a b"), (6, "\u65e5\u672c\u8a9e" * 40), (7, "x" * 5000), (8, prose(r, 30_000)), (None, "left out"), (9, "\U0001d518\U0001d518 b")])
    compare(spark, [(3, "alone again")])
    assert S.compare_edits(spark.createDataFrame([], DOC)).count() == 0
    twice = [(6, "a b"), (6, "a b"), (None, "c d"), (None, "c d")]
    got = S.compare_edits(spark.createDataFrame(twice, DOC)).collect()
    assert len(got) == 4 and len({x["fingerprint"] for x in got if x["doc_id"] == 6}) == 1


def test_short_texts_are_found_again(spark):
    r = random.Random(7)
    rows = [(i, prose(r, r.randint(6, 18))) for i in range(400)]
    got = S.compare_edits(spark.createDataFrame(rows, DOC)).collect()
    assert sum(x["near_edited"] > 0.3 for x in got) > 0.95 * len(got) and len({x["fingerprint"] for x in got}) == len(got)
    assert sum(x["near_next"] < 0.3 for x in got) > 0.95 * len(got)


def test_merged_holds_both(spark):
    r = random.Random(8)
    a, b = prose(r, 200), prose(r, 90)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(
        S.merged(S.sketch(F.col("a")), S.sketch(F.col("b"))).alias("m"), S.sketch(F.col("b")).alias("s")).select(
        "m.words", S.containment(F.col("m"), F.col("s"), F.lit(False)).alias("c")).first()
    assert row["words"] == sorted({*plain(a)[0], *plain(b)[0]}) and row["c"] == 1.0
