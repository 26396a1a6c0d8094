"""Repair of conversations: the cheapest edits that make the turns of each an opening and whole exchanges.

The roles of a repaired conversation are nothing, or a system turn if there is one and then exchanges of a user's and an assistant's turn. A grammar
of four states says so; turns may be kept, given another role, deleted, or inserted empty, at the costs below. Rows are
hash-partitioned by conversation and sorted by turn. Each batch of a partition goes through one DuckDB query
that recurses over the turns: every recursion takes all conversations of the batch one turn further and keeps, for each state of the
grammar, the least cost and its audit (the edits' initials). Of two audits of one cost that took the same turns to the same state neither is
the beginning of the other, so the smaller stays the smaller whatever follows, and least audits are exact.

A conversation may be of any length: it is cut into stretches of ``stretch`` turns, each walked from every state at once, so that a recursion
has no more than ``stretch`` steps, and stretches are put together one after the other. What is kept of a conversation is, for each state, its cost,
audit and a running hash of the repaired lines; rows pass in batches and are never gathered. A digest of a
conversation is a sequential thing, so its rows pass through one task, as a stream.

Faults, of which a row's first counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation),
truncated (its last character that isn't white space doesn't end a sentence). Equal rows of one turn travel as one row with a count.

Defined results: a null role or text counts as one blank; null turns come first and leave no gap; rows of one turn come in order of role, then
text; repeated rows are duplicates; a null conversation id is a conversation; roles go by their first character, in the case they have, and others than s, u and a must be given
another role or deleted; a conversation whose rows have all been dropped has zeros, an empty audit and the hash of nothing;
an empty table gives no rows; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_TABLE_SQL, crc_sql, slices

WHITE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
#: Costs of the edits; what a truncated turn costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: States of the grammar: nothing yet, after the system turn, after a user's turn, after an assistant's.
EMPTY, OPENED, ASKED, ANSWERED = range(4)
#: state -> {initial: next state}
GRAMMAR = {EMPTY: {"s": OPENED, "u": ASKED}, OPENED: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
ROLES = {"u": "user", "a": "assistant"}
FINAL = (EMPTY, ANSWERED)


def _given(state: int) -> tuple[str, int]:
    """The role that an inserted turn, or one with a new role, has in a state, and the state after it."""
    initial = "a" if state == ASKED else "u"
    return ROLES[initial], GRAMMAR[state][initial]


def _insertions(state: int) -> dict[int, int]:
    """How many insertions lead to each state."""
    found, at = {state: 0}, state
    while (after := _given(at)[1]) not in found:
        found[after] = found[at] + 1
        at = after
    return found


#: What closes a conversation from each state: the insertions until it is whole.
_CLOSING = {s: min(k for to, k in _insertions(s).items() if to in FINAL) for s in GRAMMAR}


def _steps() -> list[tuple]:
    """(from, initial, must go, to, cost, edits, stays): all ways to take one turn, with the insertions ahead of it."""
    found = []
    for start in GRAMMAR:
        for at, inserted in _insertions(start).items():
            ahead, cost = "I" * inserted, INSERT * inserted
            for initial in ("s", "u", "a", ""):
                for must_go in (False, True):
                    found.append((start, initial, must_go, at, cost + DELETE, ahead + "D", False))
                if initial in GRAMMAR[at]:
                    found.append((start, initial, False, GRAMMAR[at][initial], cost, ahead + "K", True))
                found.append((start, initial, False, _given(at)[1], cost + REROLE, ahead + "R", True))
    return found


_WALK = f"""
WITH RECURSIVE walk AS (
    SELECT piece, 0 AS place, state AS origin, state, 0::BIGINT AS cost, '' AS audit FROM seeds
    UNION ALL
    SELECT piece, place + 1, origin, next_state, best.cost, best.audit
    FROM (
        SELECT piece, place, origin, next_state, min({{'cost': walk.cost + steps.cost + again * {DELETE} + CASE WHEN stays AND truncated THEN {TRUNCATED} ELSE 0 END,
            'audit': audit || edits || repeat('D', again)}}) AS best
        FROM walk JOIN turns USING (piece, place) JOIN steps USING (state, initial, must_go)
        GROUP BY ALL))
SELECT piece, origin, state, cost, audit FROM walk JOIN lengths USING (piece, place)
"""


class Walker:
    """Runs the recursion over the stretches of a batch."""

    def __init__(self, memory: str = "256MB"):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory})
        self.con.execute("CREATE TABLE steps (state INT, initial VARCHAR, must_go BOOLEAN, next_state INT, cost BIGINT, edits VARCHAR, stays BOOLEAN)")
        self.con.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?, ?, ?)", _steps())

    def __call__(self, pieces: list[list[tuple]], seeds: list[list[int]]) -> list[dict]:
        """For each piece {state at the end: [(state at its start, cost, audit)]}."""
        turns = [(p, i, *turn) for p, piece in enumerate(pieces) for i, turn in enumerate(piece)]
        columns = list(zip(*turns, strict=True)) or [()] * 6
        self.con.register(
            "turns",
            pa.table(
                {
                    "piece": pa.array(columns[0], pa.int32()),
                    "place": pa.array(columns[1], pa.int32()),
                    "initial": pa.array(columns[2], pa.string()),
                    "must_go": pa.array(columns[3], pa.bool_()),
                    "truncated": pa.array(columns[4], pa.bool_()),
                    "again": pa.array(columns[5], pa.int64()),
                }
            ),
        )
        starts = [(p, s) for p, of in enumerate(seeds) for s in of]
        self.con.register("seeds", pa.table({"piece": pa.array([p for p, _ in starts], pa.int32()), "state": pa.array([s for _, s in starts], pa.int32())}))
        self.con.register("lengths", pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "place": pa.array(map(len, pieces), pa.int32())}))
        found: list[dict] = [{} for _ in pieces]
        for piece, origin, state, cost, audit in self.con.execute(_WALK).fetchall():
            found[piece].setdefault(state, []).append((origin, cost, audit))
        return found


class _Open:
    """A conversation whose rows are still passing: for each state the cost, the audit, and the repaired lines so far."""

    def __init__(self, conv, texts: bool):
        self.conv, self.texts = conv, texts
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.last = None
        self.turns = 0
        self.states = {EMPTY: (0, "", hashlib.sha256(), False, [])}
        self.pending = None

    def count(self, turn, role, n, first, blank, truncated) -> None:
        if turn is not None and turn != self.most:  # they come in order
            self.turns += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        again = n if blank or not first else n - 1
        if blank:
            self.blank += n
        else:
            self.duplicate += again
            self.truncated += bool(first and truncated)
        self.illegal += n - 1 + (self.last is not None and self.last + role[:1] not in ("su", "ua", "au"))
        self.last = role[:1]

    def add(self, rows: list[tuple], walked: dict) -> None:
        self._settle()
        self.pending = (rows, walked)

    def _best(self) -> dict:
        """state -> (cost, audit, state at the start of the pending stretch, the stretch's audit)"""
        if self.pending is None:
            return {s: (cost, audit, s, "") for s, (cost, audit, *_) in self.states.items()}
        found = {}
        for state, ways in self.pending[1].items():
            ways = [(self.states[o][0] + cost, o, audit) for o, cost, audit in ways if o in self.states]
            if ways:
                least = min(w[0] for w in ways)
                found[state] = min((least, self.states[o][1] + audit, o, audit) for cost, o, audit in ways if cost == least)
        return found

    def _lines(self, origin: int, audit: str):
        """The repaired turns of the pending stretch."""
        state, rows, skip = origin, iter(self.pending[0] if self.pending else ()), 0
        for edit in audit:
            if edit == "I":
                role, state = _given(state)
                yield role, ""
            elif skip:
                skip -= 1
            else:
                role, text, n = next(rows)
                skip = n - 1
                if edit == "K":
                    state = GRAMMAR[state][role[:1]]
                    yield role, text
                elif edit == "R":
                    role, state = _given(state)
                    yield role, text

    def _written(self, origin: int, audit: str):
        _, _, sha, some, kept = self.states[origin]
        sha, kept = sha.copy(), list(kept)
        for role, text in self._lines(origin, audit):
            sha.update((("\n" if some else "") + f"{role}:{text}").encode())
            some = True
            if self.texts:
                kept.append({"role": role, "text": text})
        return sha, some, kept

    def _settle(self) -> None:
        if self.pending is not None:
            self.states = {s: (cost, whole, *self._written(origin, audit)) for s, (cost, whole, origin, audit) in self._best().items()}
            self.pending = None

    def close(self) -> dict:
        ends = [(cost + INSERT * _CLOSING[s], whole + "I" * _CLOSING[s], origin, audit + "I" * _CLOSING[s]) for s, (cost, whole, origin, audit) in self._best().items()]
        cost, whole, origin, audit = min(ends)
        sha, _, kept = self._written(origin, audit)
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        found = {"conv": self.conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated}
        found |= {"illegal": self.illegal, "cost": cost, "audit": whole, "digest": sha.hexdigest()}
        return found | ({"repaired": kept} if self.texts else {})


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the damage that tests of the repair do, by a hash of conversation and turn; 0 copies of dropped rows."""
    blank = F.lit(" ")
    of = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    role, text = of("role"), of("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 0, blank).when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 0, blank).when(kind == 1, "").when(kind == 2, F.translate(text, "".join(ENDS), "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair(conversations: DataFrame, copies: Column | None = None, texts: bool = True, stretch: int = 64, batch_rows: int = 4096) -> DataFrame:
    """One row a conversation (conv_id): gaps in its turns, faults (blank, duplicate, truncated, illegal neighbours), cost, audit, digest of the repaired
    lines ``role:text``, and, with ``texts``, the repaired turns themselves. ``copies``: how many equal rows a row stands for (1), none of
    which leaves its conversation there without that row. A batch goes through the recursion in stretches of ``stretch`` turns."""
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("n"),
    )
    # equal rows become one before they travel
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    present = F.when(F.col("n") > 0, 1)
    same = Window.partitionBy("conv_id", "role", "text").orderBy(present.asc_nulls_last(), F.col("turn").asc_nulls_first())
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = (
        rows.repartition("conv_id")
        .withColumn("first", F.row_number().over(same) == 1)
        .withColumn("blank", trimmed == "")
        .withColumn("truncated", ~F.substring(trimmed, -1, 1).isin(*ENDS))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )
    long = T.LongType()
    counted = [T.StructField(c, long) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *counted, T.StructField("audit", T.StringType()), T.StructField("digest", T.StringType())])
    if texts:
        schema = schema.add("repaired", T.ArrayType(turn))

    def emitted(closed: list[dict], conv_type) -> pa.RecordBatch:
        values = [pa.array([c["conv"] for c in closed], conv_type)]
        values += [pa.array([c[f.name] for c in closed], pa.int64()) for f in counted]
        values += [pa.array([c[k] for c in closed], pa.string()) for k in ("audit", "digest")]
        if texts:
            values.append(pa.array([c["repaired"] for c in closed], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))))
        return pa.RecordBatch.from_arrays(values, names=schema.names)

    def walk(batches):
        walker, current, conv_type = Walker(), None, None
        for batch in slices(batches, batch_rows):
            conv_type = batch.schema.field("conv_id").type
            pieces, owners = [], [(current, [])] if current is not None else []  # the last one may go on
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                conv, turn_no, role, text, n, first, is_blank, is_truncated = row
                if current is None or conv != current.conv:
                    current = _Open(conv, texts)
                    owners.append((current, []))
                if n:
                    current.count(turn_no, role, n, first, is_blank, is_truncated)
                    parts = owners[-1][1]
                    if not parts or len(pieces[parts[-1]]) == stretch:
                        parts.append(len(pieces))
                        pieces.append([])
                    pieces[parts[-1]].append(row)
            compact = [[(r[2][:1] if r[2][:1] in "sua" else "", r[6] or not r[5], r[7], r[4] - 1) for r in piece] for piece in pieces]
            fresh = {parts[0] for owner, parts in owners if parts and owner.pending is None}
            walked = walker(compact, [[EMPTY] if p in fresh else list(GRAMMAR) for p in range(len(pieces))]) if pieces else []
            for owner, parts in owners:
                for p in parts:
                    owner.add([(r[2], r[3], r[4]) for r in pieces[p]], walked[p])
            if owners[:-1]:
                yield emitted([owner.close() for owner, _ in owners[:-1]], conv_type)
        if current is not None:
            yield emitted([current.close()], conv_type)

    return rows.select("conv_id", "turn", "role", "text", "n", "first", "blank", "truncated").mapInArrow(walk, schema)


def oracle() -> str:
    """SQL for DuckDB: damage and repair of ``conversations``, one row after the other."""
    kept = "[^\\x20\\x09-\\x0D]"
    return f"""
    WITH RECURSIVE {CRC_TABLE_SQL},
    kinds AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations, crc_table),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM kinds),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
    turns AS (
        SELECT conv_id, place, turn, role, text, left(role, 1) AS i,
            NOT regexp_matches(text, '{kept}') AS blank,
            row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
            NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
            lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
        FROM placed),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
            count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (NOT blank AND NOT seen AND cut) AS truncated,
            count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS last
        FROM turns GROUP BY conv_id),
    hop(s, h, edits, added) AS (VALUES (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
        (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:')),
    edit(e) AS (VALUES ('D'), ('K'), ('R')),
    way AS (
        SELECT s, i, gone, e, edits, added, h, CASE WHEN e = 'D' THEN h WHEN e = 'R' THEN CASE h WHEN 2 THEN 3 ELSE 2 END WHEN h = 0 AND i = 's' THEN 1
            WHEN h <> 2 AND i = 'u' THEN 2 WHEN h = 2 AND i = 'a' THEN 3 END AS t
        FROM hop, edit, (SELECT DISTINCT i, blank OR seen AS gone FROM turns) WHERE t IS NOT NULL AND (e = 'D' OR NOT gone)),
    walk AS (
        SELECT conv_id, 0::BIGINT AS place, 0 AS s, {{'cost': 0::BIGINT, 'audit': '', 'lines': ''}} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT conv_id, place, t, min({{
            'cost': best.cost + 3 * length(edits) + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND cut THEN 3 ELSE 0 END,
            'audit': best.audit || edits || e,
            'lines': best.lines || added || CASE e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || CASE h WHEN 2 THEN 'assistant:' ELSE 'user:' END || text END}})
        FROM (
            SELECT turns.conv_id, turns.place, way.t, walk.best, edits, e, cut, added, role, text, h
            FROM walk JOIN turns ON turns.conv_id IS NOT DISTINCT FROM walk.conv_id AND turns.place = walk.place + 1
            JOIN way ON way.s = walk.s AND way.i = turns.i AND way.gone = (blank OR seen))
        GROUP BY conv_id, place, t),
    ended AS (
        SELECT walk.conv_id, min({{'cost': best.cost + 3 * length(edits), 'audit': best.audit || edits, 'lines': best.lines || added}}) AS best
        FROM walk LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM walk.conv_id JOIN hop ON hop.s = walk.s AND (h = 3 OR h = 0)
        WHERE place = coalesce(last, 0) GROUP BY 1)
    SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.lines, 2)) AS repaired_sha256
    FROM ended LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ended.conv_id
    """
