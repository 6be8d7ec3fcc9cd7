"""Conversation repair against every edit, and against plain Python rows."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from bookrisk.llm import conversations as C

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
FOLLOW = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def cheapest(rows):
    """Least (cost, edits) of [(initial, must go, unsound)], trying all edits."""
    @cache
    def go(i, last, inserted):
        options = [(0, "")] if i == len(rows) and last in ("", "a") else []
        follow = FOLLOW[last][0]
        if inserted < 3:
            cost, edits = go(i, follow, inserted + 1)
            options.append((cost + 5, "I" + edits))
        if i < len(rows):
            initial, gone, unsound = rows[i]
            cost, edits = go(i + 1, last, 0)
            options.append((cost + 2, "D" + edits))
            if not gone:
                if initial and last + initial in ("s", "u", "su", "ua", "au"):
                    cost, edits = go(i + 1, initial, 0)
                    options.append((cost + 5 * unsound, "K" + edits))
                cost, edits = go(i + 1, follow, 0)
                options.append((cost + 1 + 5 * unsound, "R" + edits))
        return min(options, default=(1 << 40, ""))
    return go(0, "", 0)


def spread(codes):
    return [("suao"[g.index(c)], g in (C.BLANK, C.DUPLICATE), g == C.TRUNCATED) for c in codes for g in C.CODES if c in g]


@pytest.mark.parametrize("block", [1, 2, 7, 32, 1000])
def test_search_equals_every_edit(block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", block)
    C.solve.cache_clear()
    r = random.Random(block)
    for _ in range(400):
        weights = [r.random() ** 3 for _ in range(16)] if r.random() < 0.5 else [3, 30, 30, 3, 1, 2, 2, 0.2] + [1] * 8
        codes = "".join(r.choices("".join(C.CODES), weights, k=r.choice([0, 1, 2, 3, 5, 8, 13, 40])))
        assert C.solve(codes) == cheapest(spread(codes)), codes
    C.solve.cache_clear()


def test_long_conversations_take_linear_work():
    r = random.Random(1)
    codes = "".join("ua"[i % 2] if r.random() < 0.9 else r.choice("uaUA12") for i in range(30_000))
    cost, edits = C.solve(codes)
    assert len(edits.replace("I", "")) == len(codes) and cost > 0
    C.solve.cache_clear()


def damage(rows):
    """(conv_id, turn, role, text) after damage, in order of the rows."""
    for i, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        for _ in range(0 if k == 0 else 2 if k == 3 else 1):
            yield i, t, role, text


def expected(rows):
    groups = {i: [] for i, *_ in rows}
    for i, t, role, text in damage(rows):
        groups[i].append((t is not None, t, role, hashlib.sha256(text.encode()).digest(), text))
    out = {}
    for i, found in groups.items():
        found.sort(key=lambda x: (x[0], x[1] or 0, *x[2:]))
        seen, marks, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, _, text in found:
            body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not re.search(C.NO_SPACE, text) else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(tuple(marks))
        lines, last, k = [], "", 0
        for e in audit:
            if e == "I":
                lines.append(FOLLOW[last] + ":")
                last = FOLLOW[last][0]
                continue
            role, text = found[k][2], found[k][4]
            k += 1
            if e == "D":
                continue
            role = FOLLOW[last] if e == "R" else role
            last = role[0]
            lines.append(f"{role}:{text}")
        turns = [x[1] for x in found if x[1] is not None]
        initials = [m[0] for m in marks]
        out[i] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count.values(),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def compare(df, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in df.collect()}
    want = expected(rows)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.keys() == want.keys()
    assert {i: (a, want[i]) for i, a in got.items() if a != want[i]} == {}


def test_query_equals_plain_rows(spark):
    from bookrisk.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op11_conversation_repair"](spark, SF), rows)


def test_odd_rows(spark):
    r = random.Random(8)
    rows = []
    for i in [*range(60), None]:
        for t in range(r.randint(1, 12)):
            rows.append((i, r.choice([t, t, t, 3 * t, None, 2]), r.choice(["user", "assistant", "system", "tool", "User", "", None, "unknown"]),
                         r.choice(["Yes.", "No!", "same?", "open", "", " \t", None, ". \n", "x" * 3, f"row {t}. "])))
    rows += rows[:40]  # repeated rows
    rows += [(70, -(1 << 62), "user", "far."), (70, 1 << 62, "assistant", "apart."), (71, 5, "user", "long " * 100_000)]
    rows += [(72, t, "ua"[t % 2] + "x", f"line {t}.") for t in range(700)] + [(73, t, "user", "ok.") for t in range(300)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("audit", "digest", "codes", "m", "first", "edit", "_")})
    import sys
    sys.setrecursionlimit(20_000)
    compare(C.repair(df, C.damaged(df)), rows)


def test_one_conversation_spreads_over_tasks(spark):
    rows = [(i, t, "user" if t % 2 == 0 else "assistant", f"{i} {t}.") for i, n in ((1, 500), (2, 3), (3, 40)) for t in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(C.repair(df := spark.createDataFrame(rows, ROWS).repartition(5), C.damaged(df)), rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    assert C.repair(df, C.damaged(df)).collect() == []
    one = spark.createDataFrame([(9, 1, "user", "a.")], ROWS)
    (row,) = C.repair(one, df).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (2, 0, "user", "A."), (2, 1, "assistant", "B.")], ROWS)
    got = [tuple(r)[:5] for r in C.repaired(rows, C.audits(rows)).orderBy("conv_id", "position").collect()]
    assert got == [(2, 0, "K", 0, "user"), (2, 1, "K", 1, "assistant")]
