"""Secret scans with one automaton for all rules.

A rule is a head (a regular expression) and a run of tail characters; a match takes the whole run and is kept if the
run has ``least`` characters. All rules are compiled together: syntax tree, Thompson automaton, subset
construction, minimisation, and a transition array of 256 cells for each state. One pass over the bytes of a text
carries one state for all rules and notes where some rule's head and first tail character end (or, without a head, its
``least``-th tail character). From those few places an automaton for the reversed rule walks back to the
leftmost start. Per rule, matches are leftmost, take the whole run, and don't overlap; a match that is too short is
dropped but still consumes its characters. A rule with a ``rest`` goes on after the run, as far as an automaton for
the first of ``rest`` that matches: a private key is its header, its body and its END line. Without an END line its body is what follows of
base64, blanks, line ends (escaped ones, too), quotes and key headers, so words right after a header are masked with it.

No head may hold another match of the same rule, or the first end found wouldn't belong to the leftmost start.

Defined results: a null or empty text has no spans; repeated rows give repeated rows; columns other than the id
and the text aren't read by ``find_secrets``, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import accumulate
from operator import getitem, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least: int
    value_is_tail: bool = False
    rest: tuple[str, ...] = ()


WORD = "[A-Za-z0-9_-]"
KEY = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?"
#: From a private key's header to its END line, whatever stands between; else all that can belong to a body cut short.
KEY_BODY = (
    rf"(?:[\x00-,.-\xff]|-{{1,4}}[\x00-,.-\xff])*-----END {KEY}-----",
    r"""(?:[A-Za-z0-9+/=\x20\t\r\n\\"']|Proc-Type:\x20?[0-9],[A-Z-]+|DEK-Info:\x20?[A-Z0-9-]+,[0-9A-Fa-f]+|(?:Version|Comment):[\x20-\[\]-\xff]*)*""",
)
#: The first three are the base rules; the others add well-known key formats.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        "[A-Za-z0-9+/_.=-]",
        6,
        True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]", 16),
    Rule("hex", "", "[0-9a-f]", 24),
    Rule("github", "gh[opsru]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", WORD, 35),
    Rule("jwt", rf"eyJ{WORD}+\.eyJ{WORD}+\.", WORD, 10),
    Rule("pem", f"-----BEGIN {KEY}", "-", 5, rest=KEY_BODY),
)
BASE = ("assign", "access", "hex")


class Nfa:
    """Thompson's construction from Python's own regular-expression syntax tree; byte sets are 256-bit masks."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def step(self, mask: int) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a].append((mask, b))
        return a, b

    def chain(self, parts: list[tuple[int, int]]) -> tuple[int, int]:
        if not parts:
            a = self.state()
            return a, a
        for (_, end), (start, _) in zip(parts, parts[1:], strict=False):
            self.empty[end].append(start)
        return parts[0][0], parts[-1][1]

    def build(self, tree, fold: bool, back: bool) -> tuple[int, int]:
        parts = [self.one(str(op), arg, fold, back) for op, arg in tree]
        return self.chain(parts[::-1] if back else parts)

    def one(self, op: str, arg, fold: bool, back: bool) -> tuple[int, int]:
        if op == "LITERAL":
            return self.step(_mask({arg}, fold))
        if op == "IN":
            chosen = set()
            for kind, x in arg:
                if str(kind) == "LITERAL":
                    chosen.add(x)
                elif str(kind) == "RANGE":
                    chosen.update(range(x[0], x[1] + 1))
                else:
                    raise ValueError(f"not supported in a set: {kind}")
            return self.step(_mask(chosen, fold))
        if op == "SUBPATTERN":
            return self.build(arg[3], fold or bool(arg[1] & re.IGNORECASE), back)
        if op == "BRANCH":
            a, b = self.state(), self.state()
            for branch in arg[1]:
                start, end = self.build(branch, fold, back)
                self.empty[a].append(start)
                self.empty[end].append(b)
            return a, b
        if op == "MAX_REPEAT":
            low, high, inner = arg
            parts = [self.build(inner, fold, back) for _ in range(low)]
            if high == re._parser.MAXREPEAT:
                start, end = self.build(inner, fold, back)
                a, b = self.state(), self.state()
                self.empty[a] += [start, b]
                self.empty[end] += [start, b]
                parts.append((a, b))
            else:
                for _ in range(high - low):
                    start, end = self.build(inner, fold, back)
                    a, b = self.state(), self.state()
                    self.empty[a] += [start, b]
                    self.empty[end].append(b)
                    parts.append((a, b))
            return self.chain(parts)
        raise ValueError(f"not supported: {op}")

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _mask(chosen: set[int], fold: bool) -> int:
    if fold:
        chosen = chosen | {ord(f(chr(c))) for c in chosen if c < 128 for f in (str.lower, str.upper)}
    return sum(1 << c for c in chosen)


def compile_rules(patterns: list[str], search: bool, back: bool = False) -> list[list]:
    """Minimal deterministic automaton of all patterns. Each state is a list of 256 next states and, last, the tuple of
    patterns that end here. With ``search`` a match may start anywhere; without, a dead state ends in None."""
    nfa, starts, final = Nfa(), [], {}
    for k, pattern in enumerate(patterns):
        a, b = nfa.build(re._parser.parse(pattern), False, back)
        starts.append(a)
        final[b] = k
    masks = {m for moves in nfa.moves for m, _ in moves}
    classes: dict[tuple, list[int]] = defaultdict(list)
    for byte in range(256):
        classes[tuple(m >> byte & 1 for m in masks)].append(byte)
    letters = [bytes_[0] for bytes_ in classes.values()]
    first = nfa.closure(starts)
    ids, table, todo = {first: 0}, [], [first]
    for subset in todo:
        row = []
        for byte in letters:
            goal = {t for s in subset for m, t in nfa.moves[s] if m >> byte & 1}
            goal = nfa.closure(goal | set(starts) if search else goal)
            if goal not in ids:
                ids[goal] = len(ids)
                todo.append(goal)
            row.append(ids[goal])
        table.append(row)
    ends = [tuple(sorted({final[s] for s in subset if s in final})) for subset in todo]
    block = {e: i for i, e in enumerate(dict.fromkeys(ends))}
    block_of = [block[e] for e in ends]
    while True:
        keys = [(block_of[s], *(block_of[t] for t in table[s])) for s in range(len(table))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        if len(names) == len(set(block_of)):
            break
        block_of = [names[k] for k in keys]
    rows = [[None] * 257 for _ in set(block_of)]
    for s, row in enumerate(table):
        out = rows[block_of[s]]
        out[256] = ends[s]
        for bytes_, t in zip(classes.values(), row, strict=True):
            for byte in bytes_:
                out[byte] = rows[block_of[t]]
    if not search:
        dead = [r for r in rows if not r[256] and all(x is r for x in r[:256])]
        for r in rows:
            r[:256] = [None if any(x is d for d in dead) else x for x in r[:256]]
    start = rows[block_of[0]]
    return [start, *(r for r in rows if r is not start)]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        ends = [r.head + r.tail if r.head else f"{r.tail}{{{r.least}}}" for r in rules]
        self.states = compile_rules(ends, search=True)
        self.back = [compile_rules([e], search=False, back=True)[0] for e in ends]
        self.rests = [[compile_rules([x], search=False)[0] for x in r.rest] for r in rules]
        self.tails = [frozenset(b for b in range(256) if re.match(r.tail.encode(), bytes([b]))) for r in rules]

    def spans(self, data: bytes) -> list[tuple[str, int, int, int]]:
        """(kind, start, end, start of the value) as byte offsets, by start, then in the order of the rules."""
        states = accumulate(data, getitem, initial=self.states[0])
        found, free = [], [0] * len(self.rules)
        marks = filter(itemgetter(1), enumerate(map(itemgetter(256), states)))
        for end, ending in marks:
            for k in ending:
                if end <= free[k]:
                    continue
                start, at, row = -1, end, self.back[k]
                while at > free[k] and (row := row[data[at - 1]]) is not None:
                    at -= 1
                    if row[256]:
                        start = at
                if start < 0:
                    continue
                rule, stop, tail = self.rules[k], end, self.tails[k]
                while stop < len(data) and data[stop] in tail:
                    stop += 1
                value = end - 1 if rule.head else start
                long_enough = stop - value >= rule.least
                if long_enough:
                    stop = next((e for row in self.rests[k] if (e := self._rest(data, stop, row)) > stop), stop)
                free[k] = stop
                if long_enough:
                    found.append((start, k, stop, value if rule.value_is_tail else start))
        return [(self.rules[k].kind, start, stop, value) for start, k, stop, value in sorted(found)]

    @staticmethod
    def _rest(data: bytes, stop: int, row: list) -> int:
        """The end of the longest match from ``stop``."""
        for at in range(stop, len(data)):
            if (row := row[data[at]]) is None:
                break
            if row[256]:
                stop = at + 1
        return stop


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("value_start", T.LongType()),
    ]
)


def _points(data: bytes, text_spans: list[tuple[str, int, int, int]]) -> list[dict]:
    """Byte offsets as code points."""
    if not text_spans:
        return []
    where = sorted({x for s in text_spans for x in s[1:]})
    if data.isascii():
        points = {x: x for x in where}
    else:
        points, chars, at = {}, 0, 0
        for x in where:
            chars += len(data[at:x].decode("utf-8", "replace"))
            points[x], at = chars, x
    return [{"kind": k, "start": points[a], "end": points[b], "value_start": points[v]} for k, a, b, v in text_spans]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``id_col`` and ``spans`` (kind, start, end, value_start in code points), one for each row."""
    schema = T.StructType([docs.schema[id_col], T.StructField("spans", T.ArrayType(SPAN))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int64()) for c in ("start", "end", "value_start"))]))

    def run(batches):
        scanner = Scanner(rules)
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            spans = [_points(data, scanner.spans(data)) for data in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow)], names=[id_col, "spans"])

    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret value in ``text_col`` replaced by ``mask``; null texts stay null, and all other columns stay."""

    def run(batches):
        scanner = Scanner(rules)
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = []
            for data in batch.column(at).cast(pa.binary()).to_pylist():
                if data:
                    parts, done = [], 0
                    for _, _, stop, value in sorted(scanner.spans(data), key=itemgetter(3, 2)):
                        if value >= done:
                            parts += [data[done:value], mask.encode()]
                        done = max(done, stop)
                    data = b"".join([*parts, data[done:]])
                texts.append(data)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(pa.string()))

    return docs.mapInArrow(run, docs.schema)
