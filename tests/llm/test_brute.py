"""License scans, decontamination and the toxicity sample against plain loops."""

import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from bookrisk.llm import decontam as DC
from bookrisk.llm import langid as LG
from bookrisk.llm import licenses as LI
from bookrisk.llm import toxicity as TX

WORDS = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in "lmnrst"]


# ---------------------------------------------------------------- licenses
def brute_licenses(text, templates):
    """Every window of the grid of every template, then every place to one license."""
    def cut(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    sh, held = cut(text), defaultdict(list)
    for number, (license_, t) in enumerate(templates):
        whole = cut(t)
        kinds, g = set(whole), max(1, len(whole) // 4)
        for j in range(len(sh) // g + 1 if kinds else 0):
            window = sh[j * g:j * g + len(whole) + g - 1]
            found = len(set(window) & kinds)
            if found / len(kinds) >= 0.8:
                for o, h in enumerate(window):
                    if h in kinds:
                        held[j * g + o].append((found, found / len(kinds), license_, number, j, j * g, len(kinds), h))
    own, out = defaultdict(set), {}
    for all_ in held.values():
        best = max(x[:3] for x in all_)[2]
        for x in all_:
            if x[2] == best:
                own[x[1:7]].add(x[7])
    for (containment, license_, number, j, start, kinds), left in own.items():
        if len(left) / kinds >= 0.8:
            c, s, w = out.get(license_, (0.0, start, set()))
            out[license_] = (max(c, containment), min(s, start), w | {(number, j)})
    return {k: (c, s, len(w)) for k, (c, s, w) in out.items()}


def test_licenses_equal_every_window(spark):
    r = random.Random(5)
    templates = (*LI.TEMPLATES, *LI.NOTICES, ("Long", " ".join(r.choice(WORDS) for _ in range(300))))
    rows = []
    for i in range(120):
        parts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            words = r.choice(templates)[1].split()
            for _ in range(r.randint(0, 1 + len(words) // 25)):
                words[r.randrange(len(words))] = r.choice([*WORDS, ""])
            parts += [" ".join(words), " ".join(r.choice(WORDS) for _ in range(r.randint(0, 9)))]
        rows.append((i, "\n".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["doc_id"], x["license"]): (x["containment"], x["first_word"], x["windows"]) for x in LI.scan(docs, templates).collect()}
    want = {(i, k): v for i, t in rows for k, v in brute_licenses(t, templates).items()}
    assert got == want and len(want) > 60


def test_membership_constant(spark):
    r = random.Random(1)
    some = [r.randrange(-2**63, 2**63) for _ in range(1000)] + [-2**63, 2**63 - 1, 0, -1]
    other = [r.randrange(-2**63, 2**63) for _ in range(1000)]
    df = spark.createDataFrame([(h, h in set(some)) for h in some + other], "h long, known boolean")
    for hashes in (some, []):
        wrong = df.where(LI.member(hashes)(F.col("h")) != (F.col("known") & F.lit(bool(hashes))))
        assert wrong.count() == 0


# ---------------------------------------------------------------- decontamination
def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_matches_equal_the_edit_distance_of_every_pair(spark):
    r = random.Random(3)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 3, 6, 9, 14])))) for i in range(12)]
    docs = []
    for i in range(60):
        text = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 12)))]
        for _ in range(r.randint(0, 2)):
            t = list(r.choice(items)[1])
            for _ in range(r.randint(0, 1 + len(t) // 14)):
                at = r.randrange(len(t))
                t[at:at + r.randint(0, 1)] = r.choice(["", "x", "q", " "])
            text += ["".join(t), " ".join(r.choice(WORDS) for _ in range(r.randint(0, 5)))]
        docs.append((i, " ".join(text)))
    got = {(m["doc_id"], m["item_id"]): m["edits"] for m in DC.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=200).collect()}
    want = {}
    for i, text in docs:
        text = DC.normalise(text)
        for n, item in items:
            item = DC.normalise(item)
            if len(item) < DC.MIN_CHARS:
                if f" {item} " in f" {text} ":
                    want[i, n] = 0
            elif (e := least_edits(item, text)) <= len(item) // DC.CHARS_PER_EDIT:
                want[i, n] = e
    assert got == want
    assert len(want) > 40 and set(want.values()) >= {0, 1, 2}


def test_forms_of_letters_and_invisible_characters():
    item = "Une étude très précise de la mémoire."
    plain = DC.Matcher([(1, item)])
    for text in (item, unicodedata.normalize("NFD", item), item.replace("tu", "t\u00adu").replace("oi", "o\u200bi"), "\ufeff" + item.upper(),
                 item.replace("m", "\uff4d")):
        for matcher in (plain, DC.Matcher([(1, text)])):
            assert matcher.find(DC.normalise(text)) == [(1, 0, 0, len(item) - 1)]


# ---------------------------------------------------------------- language
def test_folded_product_equals_the_kernel_expansion():
    r = random.Random(8)
    seen = np.zeros(LG.CELLS, dtype=bool)
    texts_ = [" ".join(r.choice(WORDS[:90] if i % 2 else WORDS[60:]) for _ in range(12)) for i in range(40)]
    labels, per, ridge = ["ab"[i % 2] for i in range(40)], 5, 1e-2
    sets = [set(LG.spectrum(t, seen).tolist()) for t in texts_]

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5
    marks = [i for x in "ab" for i in [j for j, y in enumerate(labels) if y == x][:per]]
    c = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in range(40)])
    y = np.array([[1.0 if x == lang else -1.0 for lang in "ab"] for x in labels])
    alpha = np.linalg.solve(c.T @ c + ridge * 40 * c[marks] + 1e-9 * np.eye(len(marks)), c.T @ y)
    arrays = [LG.spectrum(t, seen) for t in texts_]
    m = LG.fit(arrays, labels, landmarks=per, ridge=ridge)
    got = LG.presence(arrays, m.column, len(m.weights)) @ m.weights / np.sqrt([[len(s)] for s in sets])
    assert np.allclose(got, c @ alpha, atol=2e-3)
    assert ["ab"[i] for i in got.argmax(axis=1)] == labels


# ---------------------------------------------------------------- toxicity
def test_toxicity_sample_does_not_depend_on_row_order(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(WORDS) for _ in range(8))) for i in range(300)]
    docs += [(i + 300, t + f" copy {i}") for i, t in docs[:100]]
    labels = [(i, int(r.random() < 0.3)) for i, _ in docs] + [(i, 1) for i in range(50)] + [(i, None) for i in range(20)]

    def drawn(d, known, parts):
        a = spark.createDataFrame(d, "doc_id long, text string").repartition(parts)
        b = spark.createDataFrame(known, "doc_id long, toxic int").repartition(parts)
        return sorted(map(tuple, TX._sample(a, b, 60, "doc_id", "text", "toxic").collect()))
    one = drawn(docs, labels, 1)
    assert one == drawn(docs[::-1], labels[::-1], 7) and 60 < len(one) <= 360
