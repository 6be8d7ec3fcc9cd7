"""Conversation repair by iterative-deepening A*.

The rows of a conversation, by turn, become a string of codes, one letter a
row: the initial of its role and its first fault (blank; duplicate: role and
text seen earlier in the conversation; truncated: no closing mark at the end).
Edits keep a row (0), give it the role that may follow (1), delete it (2;
blank and duplicate rows must go) or insert an empty row of that role (5); a
truncated row that stays costs 5 more. The cheapest edits whose roles read
``(system? (user assistant)+)?`` are sought depth-first, in the order of the
edits' initials D, I, K, R, under a cost bound that rises to the least cost
that exceeded it. The estimate of what lies ahead is the sum of the forced
costs, raised by a table of failed states: a state (row, last role) that could
not be finished within a cost is not tried again with as little, in this bound
or a later one. The first path found is the cheapest, and of equal costs
the first in ASCII order.

Long conversations are searched by blocks of ``BLOCK`` rows from the last one
on: a block begins in each of the four states, and its costs are the exact
estimates at which searches of the block before it end. This makes time linear
in the rows; the depth of a search is a list, not a call stack.

On Spark, rows travel without their texts: equal rows are counted first, the
first turn of each (conversation, role, text) is a grouped minimum, and codes
are gathered over ranges of (conversation, turn), so that one long conversation
spreads over many tasks; per conversation only its string of codes, then of
edits, is in one place, which the result holds as well. ``repaired`` streams
the rows of each conversation behind its edits, a row at a time.

Defined results: rows come by turn, null turns first, ties by role, then by
the SHA-256 of the text; a null role or text counts as one space; rows of a
null conversation form one conversation; roles other than system, user and
assistant are judged by their initial; a conversation without rows costs 0 and
has no edits; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookrisk.llm.common import durable

NO_SPACE = r"[^\x20\x09-\x0D]"
BLOCK = 32
#: Letters of sound, truncated, blank and duplicate rows by initial: s, u, a, other.
SOUND, TRUNCATED, BLANK, DUPLICATE = CODES = ("suao", "SUAO", "1234", "5678")
KEEP, REROLE, DELETE, INSERT, UNSOUND = 0, 1, 2, 5, 5

# what has been read: nothing, a system row, a user row, an assistant row
START, S, U, A = range(4)
NEXT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
#: The role that may follow, and the state after it.
FOLLOWS = {START: ("user", U), S: ("user", U), U: ("assistant", A), A: ("user", U)}
#: What it costs to end in a state: insertions up to an answer.
ENDING = (0, 2 * INSERT, INSERT, 0)


def _edges() -> dict[str, list[list[tuple[str, int, int]]]]:
    """By code and state: (edit, cost, step in row * 4 + state) in ASCII order."""
    out = {}
    for group in CODES:
        for initial, code in zip("suao", group, strict=True):
            out[code] = []
            extra = UNSOUND if group == TRUNCATED else 0
            for q in range(4):
                follow = FOLLOWS[q][1]
                edges = [("D", DELETE, 4), ("I", INSERT, follow - q)]
                if group in (SOUND, TRUNCATED):
                    if (q, initial) in NEXT:
                        edges.append(("K", KEEP + extra, 4 + NEXT[q, initial] - q))
                    edges.append(("R", REROLE + extra, 4 + follow - q))
                out[code].append(edges)
    return out


EDGES = _edges()
INITIALS = str.maketrans({c: i for g in CODES for i, c in zip("suao", g, strict=True)})


def _search(codes: str, low: list[int], start: int, stop: int) -> str:
    """Cheapest edits from state ``start`` to row ``stop``, from which on
    ``low`` is exact; raises ``low`` of the states that fail on the way."""
    edges = EDGES
    while True:  # one bound after the other
        letters: list[str] = []
        trail = [[start, low[start], iter(edges[codes[start >> 2]][start & 3]), 1 << 60]]
        while trail:
            frame = trail[-1]
            state, left, ahead, _ = frame
            for edit, cost, step in ahead:
                child = state + step
                need = cost + low[child]
                if need > left:
                    frame[3] = min(frame[3], need)
                    continue
                letters.append(edit)
                if child >> 2 == stop:
                    return "".join(letters)
                trail.append([child, left - cost, iter(edges[codes[child >> 2]][child & 3]), 1 << 60])
                break
            else:  # failed within what was left
                trail.pop()
                low[state] = max(low[state], frame[3])
                if trail:
                    letters.pop()
                    before = trail[-1]
                    before[3] = min(before[3], before[1] - left + low[state])


def after(state: int, edit: str, initial: str) -> int:
    """The state after an edit of a row with this initial."""
    return state if edit == "D" else NEXT[state, initial] if edit == "K" else FOLLOWS[state][1]


@lru_cache(maxsize=20_000)
def solve(codes: str) -> tuple[int, str]:
    """Least cost and edits of a conversation given by its codes."""
    n = len(codes)
    if not n:
        return 0, ""
    low = [*([0] * 4 * n), *ENDING]
    borders = [*range(0, n, BLOCK), n]
    for begin, stop in reversed([*pairwise(borders)]):
        least = min(low[4 * stop:4 * stop + 4])  # each path passes one of these states
        for i in range(stop - 1, begin - 1, -1):
            least += 0 if codes[i] in SOUND else DELETE
            low[4 * i:4 * i + 4] = [least] * 4
        for q in range(4) if begin else ():
            _search(codes, low, begin * 4 + q, stop)
    state, edits = START, []
    for row, stop in pairwise(borders):
        found = _search(codes, low, row * 4 + state, stop)
        for e in found:
            state = after(state, e, codes[row].translate(INITIALS) if e == "K" else "")
            row += e != "I"
        edits.append(found)
    edits.append("I" * (ENDING[state] // INSERT))
    return low[START], "".join(edits)


def _illegal(codes: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in pairwise(codes.translate(INITIALS)))


JUDGED = "struct<blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"


def _judged(values: pa.Array) -> pa.Array:
    rows = []
    for codes in values.to_pylist():
        count = {g: sum(map(codes.count, g)) for g in CODES}
        cost, audit = solve(codes)
        rows.append((count[BLANK], count[DUPLICATE], count[TRUNCATED], _illegal(codes), cost, audit))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
                                      names=["blank", "duplicate", "truncated", "illegal", "cost", "audit"])


# ------------------------------------------------------------- on Spark
def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of role and text as one space."""
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return conversations.select("conv_id", "turn", *space)


def damaged(conversations: DataFrame) -> DataFrame:
    """Damage by crc32(``conv_id:turn``) mod 20: 0 drops a row, 1 empties its
    text, 2 removes its closing marks, 3 repeats it, 4 gives it to the user."""
    rows = rows_of(conversations)
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_")).drop("_")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def _codes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, codes): equal rows as one."""
    at = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.lit(0)), F.lit(4))
    initial = F.when(F.length("role") == 0, 4).otherwise(at)
    slim = rows.select("conv_id", "turn", "role", _digest().alias("digest"), initial.cast("int").alias("initial"),
                       (~F.col("text").rlike(NO_SPACE)).alias("blank"),
                       F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("closed"))
    key = ["conv_id", "role", "digest"]
    counted = durable(slim.groupBy(*key, "turn", "initial", "blank", "closed").agg(F.count(F.lit(1)).cast("int").alias("m")))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.where(~F.col("blank")).groupBy(*key).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("turns"))
    again = firsts.where("turns > 1").select(*[F.col(c).alias(f"f_{c}") for c in key], "first")
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    joined = counted.join(again, same, "left")

    def letter(group: str) -> Column:
        return F.substring(F.lit(group), F.col("initial"), 1)
    later = F.col("first").isNotNull() & ~turn.eqNullSafe(F.col("first"))
    once = F.when(F.col("closed"), letter(SOUND)).otherwise(letter(TRUNCATED))
    codes = (F.when(F.col("blank"), F.repeat(letter(BLANK), F.col("m"))).when(later, F.repeat(letter(DUPLICATE), F.col("m")))
             .otherwise(F.concat(once, F.repeat(letter(DUPLICATE), F.col("m") - 1))))
    return joined.select("conv_id", "turn", "role", "digest", codes.alias("codes"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the codes of a run of rows of one conversation."""
    first, run = None, []

    def piece():
        schema = [*PIECE.items()]
        cells = [first.column(c) for c, _ in schema[:-1]] + [pa.array(["".join(run)], pa.string())]
        return pa.record_batch(cells, names=[c for c, _ in schema])
    for b in batches:
        ids = b.column("conv_id").to_pylist()
        codes = b.column("codes").to_pylist()
        for r, (i, c) in enumerate(zip(ids, codes, strict=True)):
            if first is None or i != first.column("conv_id")[0].as_py():
                if first is not None:
                    yield piece()
                first, run = b.slice(r, 1), []
            run.append(c)
    if first is not None:
        yield piece()


PIECE = {"conv_id": None, "turn": None, "role": None, "digest": None, "codes": None}


def audits(rows: DataFrame, all_ids: DataFrame | None = None) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text), and of
    ``all_ids``: gaps, blank, duplicate, truncated, illegal, cost, audit."""
    coded = durable(_codes(rows))
    order = ["conv_id", "turn", "role", "digest"]
    kinds = ", ".join(f"{c} {t}" for c, t in coded.select(*order, "codes").dtypes)
    runs = coded.select(*order, "codes").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_gathered, kinds)
    piece = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "codes")
    none, no_turn = F.lit(None).cast(runs.select(piece.alias("p")).schema["p"].dataType), F.lit(None).cast(coded.schema["turn"].dataType)
    parts = runs.select("conv_id", piece.alias("piece"), no_turn.alias("turn")).unionByName(
        coded.select("conv_id", "turn").distinct().select("conv_id", none.alias("piece"), "turn"))
    if all_ids is not None:
        parts = parts.unionByName(all_ids.select("conv_id").distinct().select("conv_id", none.alias("piece"), no_turn.alias("turn")))
    wide = F.max("turn").cast("decimal(38,0)") - F.min("turn").cast("decimal(38,0)") + 1 - F.count("turn")
    each = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"),
                                        F.coalesce(wide, F.lit(0)).try_cast("long").alias("gaps"))
    codes = F.array_join(F.transform("pieces", lambda p: p["codes"]), "")
    return each.select("conv_id", "gaps", F.arrow_udf(_judged, JUDGED)(codes).alias("j")).select("conv_id", "gaps", "j.*")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, turn, role, text),
    in order within each partition; inserted rows have no turn."""
    kind = dict(rows.dtypes)
    empty = [F.lit(None).cast(kind["turn"]).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("binary").alias("digest")]
    both = plans.select("conv_id", *empty, "audit").unionByName(
        rows.select("conv_id", "turn", "role", "text", _digest().alias("digest"), F.lit(None).cast("string").alias("audit")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "digest")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, todo, at, state, position, out = None, "", 0, START, 0, []

        def put(e, turn, role, text):
            nonlocal position
            out.append((conv, position, e, turn, role, text))
            position += 1

        def insert():
            nonlocal at, state
            while todo[at:at + 1] == "I":
                role, state = FOLLOWS[state]
                put("I", None, role, "")
                at += 1

        def batch():
            cells = list(zip(*out, strict=True)) or [[]] * len(fields)
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, fields.values(), strict=True)], names=list(fields))
        for b in batches:
            fields = {"conv_id": b.schema.field("conv_id").type, "position": pa.int64(), "edit": pa.string(),
                      "turn": b.schema.field("turn").type, "role": pa.string(), "text": pa.string()}
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                for i, turn, role, text, audit in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit")), strict=True):
                    if audit is not None:
                        conv, todo, at, state, position = i, audit, 0, START, 0
                        insert()
                        continue
                    e = todo[at]
                    at += 1
                    if e == "R":
                        role, state = FOLLOWS[state]
                    elif e == "K":
                        state = NEXT[state, role[:1]]
                    if e != "D":
                        put(e, turn, role, text)
                    insert()
                yield batch()
    return ordered.mapInArrow(edit, f"conv_id {kind['conv_id']}, position long, edit string, turn {kind['turn']}, role string, text string")


def digests(fixed: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, for conversations
    with rows, from the ordered partitions of ``repaired``."""
    kind = fixed.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, conv = None, None
        for b in batches:
            ids, sums = [], []
            for i, position, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 0:
                    if h is not None:
                        ids.append(conv)
                        sums.append(h.hexdigest())
                    h, conv = hashlib.sha256(), i
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            held = b.schema.field("conv_id").type
            yield pa.record_batch([pa.array(ids, held), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])
        if h is not None:
            yield pa.record_batch([pa.array([conv], held), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])
    return fixed.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row per conversation of ``conversations``: what ``audits`` says of
    ``rows`` and the SHA-256 of the repaired text."""
    plans = durable(audits(rows, conversations))
    found = digests(repaired(rows, plans)).select(F.col("conv_id").alias("of"), "repaired_sha256")
    nothing = hashlib.sha256().hexdigest()
    return plans.join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(
        *plans.columns, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
