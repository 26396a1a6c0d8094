from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from stationlake.llm import conversation_repair as cr
from stationlake.llm import queries

COLUMNS = "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest"
WHOLE = re.compile("(s?(ua)+)?")
BEGUN = re.compile("|".join(["", "s", "s?(ua)*u", "s?(ua)+"]))


def faults(rows):
    """'b', 'd', 't' or '' for each row."""
    seen, found = set(), []
    for role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        found.append("b" if not last else "d" if (role, text) in seen else "" if last in ".!?" else "t")
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, repaired lines) by trying edits in order of cost and audit."""
    of = faults(rows)
    heap = [(0, "", 0, ())]
    while True:
        cost, audit, at, done = heapq.heappop(heap)
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in done)
        if at == len(rows) and WHOLE.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in done)
        ways = [(cost + 3, audit + "I", at, (*done, (r, ""))) for r in ("user", "assistant")]
        if at < len(rows):
            ways.append((cost + 4, audit + "D", at + 1, done))
            if of[at] not in ("b", "d"):
                more = 3 * (of[at] == "t")
                ways.append((cost + more, audit + "K", at + 1, (*done, rows[at])))
                ways += [(cost + 3 + more, audit + "R", at + 1, (*done, (r, rows[at][1]))) for r in ("user", "assistant")]
        for way in ways:
            if BEGUN.fullmatch("".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in way[3])):
                heapq.heappush(heap, way)


def plain(conversations):
    """conversations: {conv_id: [(turn, role, text)]}"""
    found = []
    for conv, turns in conversations.items():
        turns = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))
        rows = [(r, x) for _, r, x in turns]
        numbers = {t for t, *_ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        of = faults(rows)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
        cost, audit, lines = cheapest(rows)
        found.append((conv, gaps, of.count("b"), of.count("d"), of.count("t"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(found, key=repr)


def frame(spark, conversations, schema="conv_id long, turn long, role string, text string"):
    return spark.createDataFrame([(c, *t) for c, turns in conversations.items() for t in turns], schema)


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "No!", "Why", "", " \n", "Yes. ", None, "ß?"]


@pytest.mark.parametrize("stretch", [1, 2, 64])
def test_equals_trying_all_edits(spark, stretch):
    draw = random.Random(stretch)
    turn = lambda: (draw.choice([None, 0, 1, 2, 5, 6]), draw.choice(ROLES), draw.choice(TEXTS))
    conversations = {c: [turn() for _ in range(draw.randint(1, 6))] for c in range(400)}
    got = cr.repair(frame(spark, conversations).repartition(3), stretch=stretch, batch_rows=7)
    got, want = sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr), plain(conversations)
    assert [(a, b, conversations[a[0]]) for a, b in zip(got, want, strict=True) if a != b] == []


def test_query_matches_sql(spark, sf_dir):
    got = queries.op11_conversation_repair(spark, sf_dir)
    compare(got.collect(), got.columns, connect(sf_dir).sql(queries.oracle_sql()["op11_conversation_repair"]))


def test_long_conversation_passes_in_stretches(spark):
    """The same result whether it is cut or not, and lines that the grammar accepts."""
    turns = [(i, "user" if zlib.crc32(b"%d" % i) % 3 else "assistant", f"text {i}{'.' * (i % 7 > 0)}") for i in range(2000)]
    one, other = (cr.repair(frame(spark, {1: turns, 2: turns[:3]}), stretch=s, batch_rows=b).orderBy("conv_id").collect() for s, b in ((64, 300), (5000, 5000)))
    assert one == other
    lines = one[0]["repaired"]
    assert WHOLE.fullmatch("".join(r["role"][0] for r in lines))
    assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in lines).encode()).hexdigest() == one[0]["digest"]


def test_edges(spark):
    conversations = {None: [(0, "user", "Hi."), (1, "assistant", "Hi!")], 7: [(None, None, None)], 8: [(3, "User", "x" * 200_000), (3, "User", "x" * 200_000)]}
    got = cr.repair(frame(spark, conversations).selectExpr("*", "1 as n", "2 as first", "3 as blank", "4 as copies"), texts=False)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == plain(conversations)
    assert "repaired" not in got.columns
    empty = cr.repair(frame(spark, conversations).limit(0))
    assert empty.count() == 0
    gone = cr.repair(frame(spark, {5: [(1, "user", "a.")]}), copies=F.lit(0)).collect()[0]
    assert (gone["cost"], gone["audit"], gone["repaired"], gone["digest"]) == (0, "", [], hashlib.sha256(b"").hexdigest())


def test_damage(spark):
    """The kinds, by a plain crc."""
    rows = {c: [(t, "assistant", "One. Two!") for t in range(30)] for c in range(5)}
    for r in cr.damage(frame(spark, rows)).collect():
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        want = {0: (" ", " ", 0), 1: ("assistant", "", 1), 2: ("assistant", "One Two", 1), 3: ("assistant", "One. Two!", 2), 4: ("user", "One. Two!", 1)}
        assert (r["role"], r["text"], r["copies"]) == want.get(kind, ("assistant", "One. Two!", 1))
    nulls = cr.damage(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string")).first()
    assert (nulls["role"], nulls["text"]) in ((" ", " "), ("user", " "), (" ", ""))
