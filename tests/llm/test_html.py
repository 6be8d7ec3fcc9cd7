"""Main text: attributes, names of furniture, recurrence against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from bookrisk.llm import html as H

WORDS = [a + b + c for a in "bdfgklmnprstvz" for b in "aeiou" for c in "lmnrst"]
PAGES = "page_id long, url string, html string"


def prose(seed, words=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


@pytest.mark.parametrize("page", [
    "<article style=\"overflow: hidden\"><p>{}</p></article>", "<p title=\"the hidden valley\">{}</p>", "<div><span data-hidden=\"no\">{}</span></div>",
    "<p data-id=\"ad\">{}</p>", "<p class=\"a\"\">{}</p>", "<p class=\"a\"\"><b x='\">{}</b></p>", "<p class='x\">{}</p>", "<p alt=class=ad>{}</p>",
    "<p aria-hidden=false>{}</p>", "<p data-class=\"nav\" data-role=\"menu\">{}</p>", "<div class=\"no-sidebar has-comments with-ad\"><p>{}</p></div>",
    "<div class=\"a\" class=\"ad\"><p>{}</p></div>", "<p a=1/b=2>{}</p>", "<div class=\"address advance readme\"><p>{}</p></div>"])
def test_attributes_do_not_hide_content(page):
    body = prose(1)
    assert H.extract(page.format(body) + "<p>" + prose(2, 200) + "</p>") == f"{body}\n{prose(2, 200)}"


@pytest.mark.parametrize("name", ["comment-list", "user-comments", "cookie-banner", "ad-box", "site-footer", "site-header", "page_header", "share-buttons",
                                  "newsletter-signup", "ad", "COMMENTS", "main-nav"])
def test_names_of_furniture_go(name):
    body = prose(3)
    for attribute in (f"class='x {name}'", f"id={name}"):
        assert H.extract(f"<article><p>{body}</p><div {attribute}><p>short words</p></div></article>") == body
        assert H.extract(f"<div {attribute}>short words</div><div><h1>T</h1><p>{body}</p></div>") == f"T\n{body}"


def test_hidden_parts_go():
    body = prose(4)
    for attribute in ("hidden", "hidden=''", "aria-hidden='true'", "role=navigation", "HIDDEN"):
        assert H.extract(f"<div><p>{body}</p><div {attribute}>away</div></div>") == body


def test_deep_and_unclosed_markup_takes_linear_time():
    t = time.time()
    assert H.extract("<b>" * 60_000 + "x" + "</i>" * 60_000) == "x"
    assert H.extract("<i><div>" + "<b>" * 60_000 + "x" + "</i>" * 60_000) == "x"
    assert H.extract("<div>" * 60_000 + "x") == "x"
    removed = dict.fromkeys(H.candidates("<div><div>x y</div></div>" * 9)[1], 5)
    H.extract("<div>" * 20_000 + "x", removed)
    assert time.time() - t < 60


def brute_gone(pages, share, least=3):
    """Hash -> signed pages, counted over the different main texts."""
    seen = dict(H.candidates(p, False) for p in pages)
    count = {}
    for hashes in seen.values():
        for h in hashes:
            count[h] = count.get(h, 0) + 1
    return {h: n if n >= H.INNER * len(seen) else -n for h, n in count.items() if n >= least and n >= share * len(seen)}


def site(n, seed=5):
    """Pages whose furniture has no telling tag or name."""
    menu = "<div><span>Home</span> <span>News</span> <span>Contact us</span></div>"
    out = []
    for i in range(n):
        body = "".join(f"<p>{prose(seed * 1000 + 10 * i + j, 40)}</p>" for j in range(3))
        out.append(f"<body>{menu}<section><div>Buy our great paper</div></section><div><h1>Page {i}</h1>{body}</div><div>All rights reserved {menu}</div></body>")
    return out


@pytest.mark.parametrize("sent", [500_000, 0])
def test_recurrence_alone_removes_furniture(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "SENT", sent)
    pages = site(12)
    rows = [(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)] + [(50 + i, f"http://one.example/c{i}", pages[0]) for i in range(30)]
    rows += [(200, None, None), (201, "odd", "")]
    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("host", "k", "g", "gone", "text")})
    got = {x["page_id"]: x["text"] for x in H.main_text(df, lists=False).collect()}
    gone = brute_gone(pages, H.SHARE)
    for i, _, p in rows:
        assert got[i] == H.extract(p, gone if p in pages else None, False)
    for i in range(12):
        assert got[i] == "\n".join([f"Page {i}", *(prose(5000 + 10 * i + j, 40) for j in range(3))])


def test_quotations_of_a_few_pages_stay(spark):
    quote = prose(77, 30)
    for kind in ("article", "div"):
        rows = [(i, f"http://few.example/{i}", f"<{kind}><p>{prose(800 + i, 80)}</p>{f'<blockquote><p>{quote}</p></blockquote>' if i < 3 else ''}</{kind}>") for i in range(10)]
        got = {x["page_id"]: x["text"] for x in H.main_text(spark.createDataFrame(rows, PAGES)).collect()}
        for i in range(10):
            assert got[i] == prose(800 + i, 80) + (f"\n{quote}" if i < 3 else "")
