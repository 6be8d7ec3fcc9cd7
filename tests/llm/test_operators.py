"""Small fixtures for every operator: brute force, edge rows, empty tables."""

import gzip
import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in "lmnrst"]


def texts(n, seed=1, words=60):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.randint(words // 2, words))) for _ in range(n)]


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame([(i, t, "xx", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], DOC)
    return df.withColumns({c: F.lit(1) for c in ("score", "fp", "size", "component_id", "block", "_mix", "edited", "u")})


EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, "a b"), (6, "a b"), (6, "a b"), (None, "left out"), (7, "long " * 30000)]


# ---------------------------------------------------------------- SimHash
def brute_simhash(rows, radius=3):
    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return [(i, fp(t)) for i, t in rows]


def brute_components(fps, radius=3):
    group = {f: f for _, f in fps}
    changed = True
    while changed:
        changed = False
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= radius and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    first = {}
    for i, f in fps:
        if i is not None:
            first[group[f]] = min(i, first.get(group[f], i))
    return sorted(((i, f"{f:016x}", first.get(group[f])) for i, f in fps), key=str)


def near_texts():
    base = texts(1, 5, 4000)[0].split()
    r, out = random.Random(2), []
    for _ in range(25):  # a long text with a few words changed moves few bits
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    return out


def test_simhash_equals_brute_force(spark):
    from bookrisk.llm.simhash import near_duplicates
    rows = list(enumerate(near_texts() + texts(30))) + [(100, None), (101, ""), (None, "left out"), (50, "A  b\tC"), (51, "a B c")]
    got = sorted(map(tuple, near_duplicates(docs_of(spark, rows)).collect()), key=str)
    want = brute_components(brute_simhash(rows))
    assert got == want and len({c for _, _, c in want}) < len(rows) - 5


def test_simhash_edges(spark):
    from bookrisk.llm.simhash import near_duplicates
    got = near_duplicates(docs_of(spark, EDGE)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(brute_simhash(EDGE))
    assert near_duplicates(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_covering_masks_meet_every_near_pair():
    from itertools import combinations
    from bookrisk.llm.simhash import covering_masks
    masks = covering_masks(3)
    for n in (1, 2, 3):
        for bits in combinations(range(64), n):
            d = sum(1 << b for b in bits)
            assert any(not d & m for m in masks)


def test_crowded_buckets_give_the_same_components(spark):
    from bookrisk.llm.simhash import connected, links
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << r.randrange(64) for _ in range(k)) & ((1 << 64) - 1) for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(12)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    def parts(e):
        out = {}
        for n, root in connected(e).collect():
            out.setdefault(root, {root}).add(n)
        return sorted(map(sorted, out.values()))
    assert parts(links(df, 3, bucket_rows=2)) == parts(links(df, 3))
    want = {}
    for _, f, c in brute_components([(s, f) for s, f in zip(signed, fps, strict=False)]):
        want.setdefault(c, []).append(f)
    assert len(parts(links(df, 3))) == sum(len(v) > 1 for v in want.values())


# ---------------------------------------------------------- decontamination
def test_decontamination_finds_edits_within_the_budget(spark):
    from bookrisk.llm.decontam import clean, matches, normalise
    items = texts(6, 9, 40)
    r, rows, want = random.Random(3), [], set()
    for n, item in enumerate(items):
        t = list(normalise(item))
        for k in range(len(t) // 16):
            t[r.randrange(len(t))] = r.choice("qxyw")
        rows.append((n, f"{texts(1, n + 50)[0]}\n{''.join(t).upper()}!! {texts(1, n + 90)[0]}"))
        want.add((n, n))
    rows += [(20 + n, t) for n, t in enumerate(texts(20, 77))] + [(99, None), (98, ""), (None, items[0]), (97, items[1] * 50), (97, items[1] * 50)]
    want |= {(None, 0), (97, 1)}
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "short one")], "item_id long, text string").withColumn("score", F.lit(1))
    docs = docs_of(spark, rows)
    for block in (1, 1 << 20):
        got = matches(docs, bench, block_bytes=block).collect()
        assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert sum(x["doc_id"] == 97 for x in got) == 2  # repeated rows
    kept = clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted([*range(20, 40), 98, 99])
    assert matches(docs.limit(0), bench).count() == 0 and matches(docs, bench.limit(0)).count() == 0
    assert clean(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_seeks_short_items(spark):
    from bookrisk.llm.decontam import clean, matches
    bench = spark.createDataFrame([(1, "What is it?"), (2, "日本の首都"), (3, "!?"), (4, "")], "item_id long, text string")
    docs = docs_of(spark, [(1, "So, WHAT is it. Yes"), (2, "what is italy"), (3, "somewhat is it"), (4, "それは日本の首都です"), (5, "what is"), (6, None)])
    got = {(x["doc_id"], x["item_id"], x["edits"], x["start"], x["length"]) for x in matches(docs, bench).collect()}
    assert got == {(1, 1, 0, 3, 10), (4, 2, 0, 3, 5)}
    assert sorted(x["doc_id"] for x in clean(docs, bench).collect()) == [2, 3, 5, 6]


def test_myers_equals_dynamic_programme():
    from bookrisk.llm.decontam import myers
    r = random.Random(1)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        t = "".join(r.choice("abc") for _ in range(r.randint(1, 30)))
        d = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            q = [i]
            for j, x in enumerate(t, 1):
                q.append(min(d[j] + 1, q[-1] + 1, d[j - 1] + (c != x)))
            d = q
        assert myers(p, t, len(p))[0] == min(min(d), len(p))


# ------------------------------------------------------------- classifiers
def test_language_id(spark):
    from bookrisk.llm import langid
    en, de = "the quick fox and the lazy dog of this town", "der schnelle fuchs und der faule hund ist nicht schön"
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(s.split(), k=12)), lang) for i in range(60) for s, lang in ((en, "en"), (de, "de"))]
    df = spark.createDataFrame([*rows, (90, None, "en"), (91, "12 34 !!", "de"), (92, "the dog", None), (93, "Der FUCHS", None), (None, "und der hund " * 90000, None)],
                               "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    model = langid.train(df, per_language=30, landmarks=10)
    got = {x["doc_id"]: x for x in langid.identify(df, model).collect()}
    assert (got[90]["lang_pred"], got[91]["lang_pred"], got[90]["score"]) == ("und", "und", 0.0)
    assert (got[92]["lang_pred"], got[93]["lang_pred"], got[None]["lang_pred"]) == ("en", "de", "de")
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.train(df.limit(0))
    assert {x["lang_pred"] for x in langid.identify(df, none).collect()} == {"und"}
    # the folded product equals the kernel expansion
    seen = np.zeros(langid.CELLS, dtype=bool)
    sets = [langid.spectrum(t, seen) for _, t, _ in rows[:40]]
    m = langid.fit(sets, [x[2] for x in rows[:40]], landmarks=5)
    for a in sets[:5]:
        assert len(a) == len(set(a)) and (langid.presence([a], m.column, len(m.weights)) @ m.weights).shape == (1, 2)


def test_quality_held_out_accuracy(spark):
    from bookrisk.llm import quality
    good, r = texts(300, 3), random.Random(8)
    rows = [(i, t if i % 3 else " ".join(w + r.choice(["###", "$$$"]) for w in t.split())) for i, t in enumerate(good)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = docs_of(spark, rows + [(900, None), (901, ""), (None, good[0])])
    got = {x["doc_id"]: x for x in quality.score(docs, quality.train(docs, labels)).collect()}
    assert sum(got[i]["keep"] == (i % 3 > 0) for i in range(200, 300)) >= 98
    assert len(got) == 303 and all(0 <= x["score"] <= 1 for x in got.values())
    empty = quality.train(docs, labels.limit(0))
    assert {x["score"] for x in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), empty).count() == 0


def test_quality_pool_holds_no_labelled_row(spark, monkeypatch):
    from bookrisk.llm import quality
    rows, seen = list(enumerate(texts(60, 78))), {}
    monkeypatch.setattr(quality, "co_train", lambda views, y, pool, **how: seen.update(labelled=len(y), pool=len(pool[0])))
    quality.train(docs_of(spark, [*rows, (None, "no id")]), spark.createDataFrame([(i, i % 2) for i, _ in rows[:50]], "doc_id long, quality int"))
    assert seen == {"labelled": 50, "pool": 11}
    monkeypatch.undo()
    model = quality.train(docs_of(spark, rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int"))
    assert quality.score(docs_of(spark, rows), model).count() == 60


def test_toxicity(spark):
    from bookrisk.llm import toxicity
    assert toxicity.fold("You 1D10T, $tup1d! оne іdіot‌s 42") == " you idiot stupid one idiots "
    clean, r = texts(200, 6), random.Random(5)
    bad = [" ".join([*t.split()[:20], r.choice(["zorkal", "zorkib"]), *t.split()[20:]]) for t in clean]
    rows = [(i, t) for i, t in enumerate(clean)] + [(1000 + i, t) for i, t in enumerate(bad)]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows if i % 4] + [(None, 1)], "doc_id long, toxic int")
    docs = docs_of(spark, rows + [(5000, None), (5001, ""), (None, "idiot")])
    model = toxicity.train(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if i % 4 == 0]
    assert sum(got[i]["predicted"] == (i >= 1000) for i in held) >= 0.98 * len(held)
    assert got[5000]["score"] == got[5001]["score"] < 0.7 and toxicity.score(docs.limit(0), model).count() == 0
    spared = toxicity.Model({" trash ": 5.0}, [" trash can "])
    assert not spared.hits(toxicity.fold("the trash can")) and spared.hits(toxicity.fold("you trash, go"))


def test_toxicity_learns_rare_markers(spark):
    from bookrisk.llm import toxicity
    clean = texts(400, 61)
    def with_word(t, word):
        return " ".join([*t.split()[:15], word, *t.split()[15:]])
    bad = [with_word(t, "zorkal") for t in texts(40, 62)] + [with_word(t, "qwyxre") for t in texts(6, 63)] + [with_word(t, "vuzzich") for t in texts(13, 64)]
    rows = list(enumerate([with_word(clean[0], "vuzzich"), *clean[1:]])) + [(1000 + i, t) for i, t in enumerate(bad)]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    unseen = [(5000 + i, with_word(t, w)) for i, (t, w) in enumerate(zip(texts(4, 65), ("qwyxre", "vuzzich") * 2, strict=True))]
    model = toxicity.train(docs_of(spark, rows), labels)
    assert {" qwyxre ", " vuzzich "} <= set(model.entries)  # 6 toxic and no clean row, 13 and one
    assert all(x["predicted"] for x in toxicity.score(docs_of(spark, unseen), model).collect())


# ------------------------------------------------------------------ mixing
def test_mixing_totals_and_limits(spark):
    from bookrisk.llm.mixing import mix, sized
    rows = [(i, t) for i, t in enumerate(texts(400, 11, 30))] + EDGE[:6] + [(6, "a b"), (None, "left out")]
    df = docs_of(spark, rows).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "tiny").otherwise(F.col("source")))
    got = mix(sized(df)).select("source", "text", "_mix.*").collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        assert x["taken"] in (0, x["size"], 2 * x["size"]) and x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or ""))
        by.setdefault(x["source"], []).append(x)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * sum(x["size"] for x in got)) < 1e-6
    for v in by.values():
        assert v[0]["source_size"] == sum(x["size"] for x in v) and v[0]["target"] <= 2 * v[0]["source_size"]
        assert abs(sum(x["taken"] for x in v) - v[0]["target"]) <= max(x["size"] for x in v)
    again = mix(sized(df)).select("source", "text", "_mix.*").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(sized(df.limit(0))).count() == 0


# --------------------------------------------------------- sketch, licenses
def test_sketch_follows_the_next_document(spark):
    from bookrisk.llm.sketch import compare_edits
    rows = [(i * 97, t) for i, t in enumerate(texts(30, 21))] + [(1, None), (2, ""), (10**9, "one two"), (-5, "x y z a b c d")]
    order = sorted(rows, reverse=True)
    got = {x["doc_id"]: x for x in compare_edits(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 3] + nxt[:len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert compare_edits(docs_of(spark, [(3, "alone again")])).first()["near_next"] == 1.0
    twice = compare_edits(docs_of(spark, EDGE)).collect()
    assert len(twice) == len(EDGE) and len({x["fingerprint"] for x in twice if x["doc_id"] == 6}) == 1
    assert compare_edits(docs_of(spark, EDGE).limit(0)).count() == 0


def test_license_scan(spark):
    from bookrisk.llm.licenses import TEMPLATES, scan
    fill = texts(40, 31, 200)
    rows = [(n, f"{fill[n]}\n{t.upper()}\n{fill[n + 20]}") for n, (_, t) in enumerate(TEMPLATES)]
    long_one = TEMPLATES[10][1].split()
    rows += [(50, " ".join(long_one[:-4])), (51, " ".join(long_one[: len(long_one) // 2])), (60, fill[0]), *[(i and i + 100, t) for i, t in EDGE]]
    got = {(x["doc_id"], x["license"]): x for x in scan(docs_of(spark, rows)).collect()}
    assert {k for k in got if k[0] is not None and k[0] < 50} == {(n, a) for n, (a, _) in enumerate(TEMPLATES)}
    assert (50, "MIT") in got and 0.8 <= got[50, "MIT"]["containment"] < 1 and {k[0] for k in got} == {*range(len(TEMPLATES)), 50}
    assert scan(docs_of(spark, rows).limit(0)).count() == 0


def test_license_scan_tells_licenses_apart(spark):
    from bookrisk.llm.licenses import ALL, NOTICES, TEMPLATES, scan
    fill = texts(3, 77, 200)
    rows = [(n, f"{fill[0]}\n{t}\n{fill[1]}") for n, (_, t) in enumerate(ALL)]
    both = [next(t for a, t in known if a == b) for known, b in ((NOTICES, "GPL-2.0"), (TEMPLATES[7:], "GPL-3.0"))]
    rows += [(500, f"{both[0]} {both[1]}"), (501, dict(ALL)["BSD-3-Clause"].replace("copyright holder", "Example Ltd"))]
    got = {}
    for x in scan(docs_of(spark, rows)).collect():
        got.setdefault(x["doc_id"], set()).add(x["license"])
    assert {n: got.get(n) for n in range(len(ALL))} == {n: {a} for n, (a, _) in enumerate(ALL)}
    assert got[500] == {"GPL-2.0", "GPL-3.0"} and got[501] == {"BSD-3-Clause"}


# -------------------------------------------------------------- WARC, HTML
def test_warc_salvage_skips_damage():
    from bookrisk.llm.warc import Gap, base32_sha1, salvage
    def record(n, payload, digest=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Payload-Digest: sha1:{digest or base32_sha1(payload)}\r\n"
                f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    good = [record(i, b"page WARC/1.1\r\nline " * i) for i in range(4)]
    assert [x.headers["warc-record-id"] for x in salvage(b"".join(good))] == [f"<urn:page:{i}>" for i in range(4)]
    broken = good[0] + good[1].replace(b"Content-Length: ", b"Content-Length: 9") + good[2] + b"noise\r\n" + record(7, b"x", "WRONG") + good[3]
    out = list(salvage(broken))
    assert [x.headers["warc-record-id"][10:-1] for x in out if not isinstance(x, Gap)] == ["0", "2", "3"]
    assert sum(x.length for x in out) == len(broken) and sum(isinstance(x, Gap) for x in out) == 2
    members = [gzip.compress(g) for g in good]
    hurt = bytearray(members[1])
    hurt[-6] ^= 255
    zipped = members[0] + bytes(hurt) + members[2] + members[3][:-3]
    out = list(salvage(zipped))
    assert [x.headers["warc-record-id"][10:-1] for x in out if not isinstance(x, Gap)] == ["0", "2"]
    assert sum(x.length for x in out) == len(zipped) and sum(isinstance(x, Gap) for x in out) == 2
    assert list(salvage(b"")) == [] and [x.reason for x in salvage(b"junk")] == ["no version line"]


def test_warc_round_trip(spark, tmp_path):
    from bookrisk.llm import warc
    rows = [(1, "http://a/\r\nX: y", "<p>é\r\n\r\nWARC/1.1\r\nWARC-Type: x</p>"), (2, None, "same"), (5, "u", "same"), (3, "u", "same"),
            (4, "u", None), (6, "u", ""), (None, "u", "lone"), (8, "u", "big " * 200000), (8, "u", "big " * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = os.path.join(str(tmp_path), "w")
    warc.write(pages, path, records_per_file=3)
    got = warc.read(spark, path, keep_payload=True).collect()
    assert {x["kind"] for x in got} == {"record"} and len(got) == len(rows)
    by = {(x["page_id"], x["record_type"], x["refers_to"]) for x in got}
    assert by == {(1, "response", None), (2, "revisit", 5), (3, "revisit", 5), (5, "response", None), (4, "revisit", 6), (6, "response", None),
                  (None, "response", None), (8, "response", None)}
    for x in got:
        if x["record_type"] == "response" and x["page_id"]:
            assert bytes(x["payload"]) == (next(h for i, _, h in rows if i == x["page_id"]) or "").encode()
    assert {x["payload_bytes"] for x in got if x["page_id"] in (2, 3, 5)} == {4}
    small = os.path.join(str(tmp_path), "small")  # files bounded by bytes: the large records apart from the others
    warc.write(pages, small, records_per_file=100, bytes_per_file=100_000)
    again = warc.read(spark, small).collect()
    assert sorted((x["page_id"] or 0, x["payload_bytes"]) for x in again) == sorted((x["page_id"] or 0, x["payload_bytes"]) for x in got)
    files = {}
    for x in again:
        files.setdefault(x["file"], []).append(x["length"])
    assert all(len(v) == 1 for v in files.values() if max(v) > 100_000) and sum(max(v) > 100_000 for v in files.values()) == 2
    long = spark.createDataFrame([(1, "http://a/" + "u" * (3 << 20), "<p>x")], "page_id long, url string, html string")
    warc.write(long, path + "l")
    (one,) = warc.read(spark, path + "l").collect()
    assert one["kind"] == "record" and len(one["uri"]) > 3 << 20
    name = [f for f in os.listdir(path) if f.startswith("part") and os.path.getsize(os.path.join(path, f))][0]
    with open(os.path.join(path, name), "rb") as f:
        whole = f.read()
    hurt = os.path.join(str(tmp_path), "hurt")
    os.mkdir(hurt)
    with open(os.path.join(hurt, "a.warc"), "wb") as f:
        f.write(b"noise\r\n" + whole + whole[:50])
    back = warc.read(spark, hurt).orderBy("offset").collect()
    assert back[0]["kind"] == back[-1]["kind"] == "gap" and (back[0]["offset"], back[0]["length"], back[0]["reason"]) == (0, 7, "no version line")
    assert sum(x["length"] for x in back) == len(whole) + 57 and all(x["kind"] == "record" for x in back[1:-1]) and len(back) > 2
    warc.write(pages.limit(0), path + "0")
    assert warc.read(spark, path + "0").count() == 0


def test_main_text(spark):
    from bookrisk.llm.html import extract, main_text
    assert extract("<body><header>Top</header><main><h1>A &amp; B</h1><p>one<br>two <i>th</i>ree<p>four<aside>side</aside>"
                   "<ul><li>x<li>y</ul><script>var a='</p>';</script><div class='ad-box ad'>buy</div><section id=comments>me</section>") == "A & B\none two three\nfour\nx\ny"
    assert extract("<article>a &lt; b <!-- no --> &am") == "a < b &am" and extract(None) == extract("") == ""
    assert extract("<p>cut <a hre") == "cut" and extract("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"
    body = texts(30, 41, 80)
    rows = [(i, f"http://h.example/{i}", f"<body><article><h1>T{i}</h1><p>{t}</p><div>Read our <b>paper</b></div></article><div>x</div>") for i, t in enumerate(body)]
    rows += [(100 + i, f"http://copy.example/{i}", f"<article><h1>T</h1><div><p>{body[0]}</p></div></article>") for i in range(30)]
    rows += [(200, None, None), (201, "odd", ""), (None, "http://h.example/q", "<p>z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {x["page_id"]: x for x in main_text(df).collect()}
    assert got[3]["text"] == f"T3\n{body[3]}" and got[105]["text"] == f"T\n{body[0]}"
    assert (got[200]["text"], got[201]["n_chars"], got[None]["text"]) == ("", 0, "z") and main_text(df.limit(0)).count() == 0


def test_main_text_keeps_content_with_furniture_names():
    from bookrisk.llm.html import extract
    body = " ".join(texts(1, 71, 60))
    for page in (f"<article class='post has-sidebar'><p>{body}</article>", f"<article class='comments-open tag-x share-y sidebar'><p>{body}</article>",
                 f"<div id='content-no-sidebar'><p>{body}</div>", f"<form id=aspnetForm><div><p>{body}</div></form>", f"<div class=widget><p>{body}</div>",
                 f"<form><main><p>{body}</main><div>menu</div></form>", f"<div class=share>x</div><div><p>{body}</div><form><p>Your mail</form>"):
        assert extract(page) == body, page
    cards = "<article>card one</article><article>card two</article>"
    assert extract(f"<div><p>{body}</div>{cards}") == f"{body}\ncard one\ncard two"
    assert extract(f"<main><p>{body}{cards}</main><p>out") == f"{body}\ncard one\ncard two"


def test_main_text_counts_different_pages(spark):
    from bookrisk.llm.html import main_text
    body = texts(130, 72, 80)
    copied = f"<article><p>{body[0]}</p><ul><li>{body[1][:40]}</ul></article>"
    rows = [(i, f"http://copies.example/{i}", copied) for i in range(40)]
    quoted = f"<table><tr><td>{body[129][:30]}</table>"  # on 22 of 129 different pages
    rows += [(100 + i, f"http://wide.example/{i}", f"<article><p>{t}</p>{quoted if i < 22 else ''}<div>Read our paper</div></article>") for i, t in enumerate(body[:129])]
    got = {x["page_id"]: x["text"] for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == f"{body[0]}\n{body[1][:40].strip()}"
    assert got[105] == f"{body[5]}\n{body[129][:30].strip()}" and got[200] == body[100]


def test_main_text_removes_every_kind_of_template(spark):
    from bookrisk.llm.html import main_text
    body, rows = texts(6, 73, 80), []
    for i, t in enumerate(body):
        rows.append((i, f"http://small.example/{i}", f"<title>Page {i} | Us</title><article><h1>Page</h1><p>{t} <b>never</b> {t[:9]}</p><table><tr><td>Yes<td>n{i}</table>"
                     "<p>Follow us on the net</p><ul><li>Print<li>Mail</ul><section><h2>About us</h2><p>We write</section><div><span>Share</span></div></article>"))
    near = " ".join(texts(1, 74, 90))  # three near copies among twelve pages: their text is content
    rows += [(20 + i, f"http://near.example/{i}", f"<article><p>{near}</p><p>{near[:99]}</p><p>{t}</p><p>Follow us</article>") for i, t in enumerate(texts(12, 75, 20)) if i < 3]
    rows += [(40 + i, f"http://near.example/x{i}", f"<article><p>{t}</p><p>Follow us</article>") for i, t in enumerate(texts(9, 76, 40))]
    got = {x["page_id"]: x["text"] for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, t in enumerate(body):
        assert got[i] == f"Page\n{t} never {t[:9]}".strip() + f"\nYes\nn{i}"
    assert got[20].startswith(f"{near}\n{near[:99].strip()}\n") and all("Follow" not in t for t in got.values())


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline as P
    r, good = random.Random(3), texts(120, 51)
    rows = [(i, t) for i, t in enumerate(good)] + [(500 + i, " ".join(w + r.choice(["###", "$$$"]) for w in t.split())) for i, t in enumerate(texts(60, 52))]
    rows += [(300, good[0]), (301, good[1] + " extra"), (302, None), (None, good[2]), (303, f"{good[3]} {texts(1, 99, 30)[0]}")]
    sf = str(tmp_path)
    docs_of(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i < 500), 0) for i, _ in rows if i is not None and i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, texts(1, 99, 30)[0])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = []
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/out{n}")
        out = spark.read.parquet(f"{sf}/out{n}")
        assert out.columns[:len(docs.columns)] == docs.columns
        docs, _ = out, ids.append({x["doc_id"] for x in out.collect()})
    assert not {i for i in ids[0] if i and i >= 500} and set(range(120)) <= ids[0]
    assert set(range(120)) <= ids[1] and 302 not in ids[1]
    assert 300 not in ids[2] and set(range(120)) <= ids[2] and None in ids[2]
    assert ids[3] == ids[2] - {303}
    assert ids[4] <= ids[3] and P.run(spark, sf).count() == docs.count()


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline as P
    names = ["target", "part", "whole", "before", "rank", "range", "_mix", "mix_size", "mix_taken", "__lang", "__row", "__quality", "rest", "mean", "source_size",
             "p_source", "r_source", "ahead", "row", "mix", "key", "n", "t", "judged", "_mix_size", "factor", "u", "fp", "score", "a.b"]
    good = texts(40, 61)
    rows = [(i, t) for i, t in enumerate(good)] + [(100, good[0])]
    base = spark.createDataFrame([(i, t, "xx", f"s{i % 3}", len(t)) for i, t in rows], DOC)
    docs = base.withColumns({f"{c}": F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in names})
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(999, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, texts(1, 99, 30)[0])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        got = out.collect()
        assert got, name
        for r in got:
            assert all(r[c] == f"{c}-{r['doc_id']}" for c in names), name
            assert r["text"] == dict(rows)[r["doc_id"]]


def test_mixing_by_weight_shares_what_heavy_rows_cannot_take(spark):
    from bookrisk.llm.mixing import mix, sized
    rows = [(i, "w " * 10, "a", "s", 100.0 if i < 5 else 1.0) for i in range(105)]
    df = spark.createDataFrame([(i, t, la, s, 20, w) for i, t, la, s, w in rows], DOC + ", weight double")
    taken, heavy = {}, 0
    for salt in range(12):
        got = mix(sized(df, weight="weight", salt=f"z{salt}"), share=0.5, weighted=True).select("doc_id", "_mix.*").collect()
        assert abs(sum(r["taken"] for r in got) - 525) <= 10 and max(r["copies"] for r in got) <= 2
        heavy += sum(r["copies"] for r in got if r["doc_id"] < 5)
        for r in got:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["copies"]
    assert heavy == 12 * 10  # the heavy rows are full
    light = [taken[i] / 12 for i in range(5, 105)]
    assert abs(sum(light) / 100 - 0.425) < 0.02 and max(light) < 1
    odd = df.withColumn("weight", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("weight")))
    assert mix(sized(odd, weight="weight"), weighted=True).count() == 105
    assert mix(sized(df.limit(0), weight="weight"), weighted=True).count() == 0


def test_near_dedup_stage_judges_rows(spark):
    import corpus_pipeline as P
    a, b, c, d = texts(4, 79)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d), (None, f"{d} "), (None, a), (4, None)]
    out = P.near_dedup_stage(spark, docs_of(spark, rows), "")
    got = sorted(((x["doc_id"], (x["text"] or "").strip()) for x in out.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (None, d), (None, a), (4, "")], key=str)
    assert P.near_dedup_stage(spark, docs_of(spark, rows).limit(0), "").count() == 0
