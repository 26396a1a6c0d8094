"""Language-model scores by a weighted backoff automaton over words, pairs and triples.

The model: p(w) is the base distribution, additively smoothed counts of the training tokens with one share for all unknown
words; p(w | b) = (c(b w) + k2 p(w)) / (c(b) + k2), and p(w | a b) = (c(a b w) + k3 p(w | b)) / (c(a b) + k3), which sum to one
for every context, the start of a text among them. As an automaton: a state for each pair that training texts go on from, one for each
word, and the root. A triple that was seen is an arc from its pair's state that bears log10 p(w | a b) and leads to the
state of its last two words; every other word takes the failure arc to the state of b, which bears log10(k3 / (c(a b) + k3)). There
a pair that was seen is an arc with log10 p(w | b) to the pair's state; every other word takes the failure arc to
the root, which bears log10(k2 / (c(b) + k2)), and there the arc of w, known or not. A text is scored in one traversal
from left to right that carries the state and adds up the weights. Each k is set such that the number of different pairs or
triples that the model expects, given how often each context occurs, is the number counted.

At scale the automaton is never in one place. Texts are dealt into blocks of bounded size, by a hash of the id, the text and the input
partition, so that rows of one id are no block of their own. A block names the words, pairs and triples it holds, with its training
counts, to the slots that their hashes belong to; a slot adds the counts up and answers each block; a block then builds the
part of the automaton that its own texts can reach, and traverses it. So work and traffic grow with the input, memory doesn't, and
frequent words weigh no more than rare ones, as every block names each once. What is named travels as sorted 40-bit hashes,
where they are close as 32-bit differences, and counts as bytes with an escape; with the slot, that tells apart 40 bits among
the keys of one slot. ``docs`` is read twice and has to be a table, or another plan whose partitions are the same each time.

Defined results: a null text counts as empty and consists of the end alone; a null id is learned from; repeated
rows count and are scored each; without training rows the base distribution is all; columns other than the id
and the text aren't read, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import settle

END = b""
START = np.uint64(0x9E3779B97F4A7C15)
WORD, PAIR, TRIPLE = KINDS = 0, 1, 2
NO_WORD = np.uint64(0x632BE59BD9B4E019)
#: Contexts are counted by the power of two of their frequency.
BINS = 48


class Vocabulary(dict):
    """Word -> its number in a block; the hashes by number. The end of a text has number 0."""

    def __init__(self):
        self.hashes: list[int] = []
        self[END]  # noqa: B018

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0xBF58476D1CE4E5B9) ^ (right << np.uint64(31) | right >> np.uint64(33))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(29)


class Block:
    """The tokens of some texts, and the words, pairs and triples they hold. ``str.split`` on bytes cuts at exactly the six ASCII
    blanks, and ``lower`` maps ASCII letters alone."""

    def __init__(self, texts: list[bytes]):
        vocabulary, parts = Vocabulary(), []
        for text in texts:
            words = text.lower().split()
            words.append(END)
            parts.append(np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int32, count=len(words)))
        self.lengths = np.array([len(p) for p in parts], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.tokens = np.concatenate(parts)
        words = np.array(vocabulary.hashes, dtype=np.uint64)
        #: The word ahead of each token; the start of a text has the number after all words.
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = len(words)
        self.before = before
        keys = pair_keys(np.append(words, START)[before], words[self.tokens])
        pairs, self.first_pair, self.pair_of = np.unique(keys, return_index=True, return_inverse=True)
        #: Tokens that have a pair ahead of them, all but the first ones, and their triples.
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        keys = pair_keys(pairs[self.pair_of[self.inner - 1]] ^ NO_WORD, words[self.tokens[self.inner]])
        triples, first, self.triple_of = np.unique(keys, return_index=True, return_inverse=True)
        self.first_triple = self.inner[first]
        self.keys = {WORD: words, PAIR: pairs, TRIPLE: triples}

    def counts(self, learn: np.ndarray) -> dict[int, np.ndarray]:
        """Of each kind, how often its members occur in the tokens for which ``learn`` holds."""
        of = {WORD: self.tokens[learn], PAIR: self.pair_of[learn], TRIPLE: self.triple_of[learn[self.inner]]}
        return {kind: np.bincount(of[kind], minlength=len(self.keys[kind])) for kind in KINDS}

    def named(self, kind: int, slots: int):
        """(slot, positions among the block's members of a kind) for each slot; the order depends on the keys alone."""
        keys = self.keys[kind]
        slot = keys % np.uint64(slots)
        order = np.lexsort((short(keys), slot))
        cuts = np.flatnonzero(np.diff(slot[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(slot[part[0]]), part


def short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(24)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 40-bit keys: the first whole, then differences of 32 bits, or all of them whole if a difference is larger."""
    steps = np.diff(keys)
    if len(steps) and int(steps.max()) >> 32:
        return b"\1" + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return b"\0" + keys[:1].astype("<u8").tobytes() + steps.astype("<u4").tobytes()


def unpack_keys(data: bytes) -> np.ndarray:
    if data[0]:
        five = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, 5)
        whole = np.zeros((len(five), 8), dtype=np.uint8)
        whole[:, :5] = five
        return whole.view("<u8")[:, 0]
    first = np.frombuffer(data, dtype="<u8", count=1, offset=1)
    return np.concatenate([first, first + np.cumsum(np.frombuffer(data, dtype="<u4", offset=9), dtype=np.uint64)])


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; those from 255 on follow whole."""
    large = counts[counts >= 255].astype("<u8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, dtype="<u8", offset=n)
    return counts


class Automaton:
    """States from 0 on; -1 is the root, which has an arc for each symbol. ``arcs`` are state << 32 | symbol, each with its weight
    and next state; a state's failure arc has a weight and leads to a state."""

    def __init__(self, arcs, weights, targets, failure, fallback, root, root_targets):
        by = np.argsort(arcs)
        self.arcs, self.weights, self.targets = arcs[by], weights[by], targets[by]
        self.failure, self.fallback, self.root, self.root_targets = failure, fallback, root, root_targets

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, next state) for many traversals at once."""
        weight, following = np.zeros(len(state)), self.root_targets[symbol]
        at_root = state < 0
        weight[at_root] = self.root[symbol[at_root]]
        on = np.flatnonzero(~at_root)
        here = state[on]
        while len(on):
            key = here << 32 | symbol[on]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            weight[on[hit]] += self.weights[at[hit]]
            following[on[hit]] = self.targets[at[hit]]
            on, here = on[~hit], here[~hit]
            weight[on] += self.failure[here]
            here = self.fallback[here]
            fell = here < 0
            weight[on[fell]] += self.root[symbol[on[fell]]]
            on, here = on[~fell], here[~fell]
        return weight, following


def traverse(automaton: Automaton, block: Block, start: int, stretch: int = 2048) -> np.ndarray:
    """The weight of each token. All texts go side by side. A long one is cut into stretches; as a state knows no more than
    two words, a stretch sets out from the root two words early and carries the right state when its own words begin."""
    begins, lengths, warm = [], [], []
    for b, n in zip(block.starts.tolist(), block.lengths.tolist(), strict=True):
        for a in range(0, n, stretch):
            early = 2 if a else 0
            begins.append(b + a - early)
            lengths.append(min(stretch, n - a) + early)
            warm.append(early)
    begins, lengths, warm = np.array(begins), np.array(lengths), np.array(warm)
    by = np.argsort(-lengths, kind="stable")
    begins, lengths, warm = begins[by], lengths[by], warm[by]
    state = np.where(warm == 0, start, -1)
    weights = np.empty(len(block.tokens))
    active = np.searchsorted(-lengths, -np.arange(int(lengths.max())), side="left")
    for t, n in enumerate(active.tolist()):
        at = begins[:n] + t
        weight, state = automaton.step(state[:n], block.tokens[at].astype(np.int64))
        if t < 2:
            own = warm[:n] <= t
            weights[at[own]] = weight[own]
        else:
            weights[at] = weight
    return weights


def build(block: Block, counts: dict[int, np.ndarray], base: np.ndarray, k2: float, k3: float) -> tuple[Automaton, int]:
    """The part of the automaton that a block's texts can reach, and the state they start in. States are words by their
    number, the start of a text, and pairs."""
    word, pair, triple = (counts[kind] for kind in KINDS)
    words = len(word)
    # the end of a text is no context; as many texts start as end
    context = np.append(word, word[0]).astype(float)
    context[0] = 0
    left, right = block.before[block.first_pair].astype(np.int64), block.tokens[block.first_pair].astype(np.int64)
    state_of_pair = np.where((pair > 0) & (right > 0), words + 1 + np.arange(len(pair)), -1)
    p2 = (pair + k2 * base[right]) / (context[left] + k2)
    seen = np.flatnonzero(pair)
    head, last, symbol = block.pair_of[block.first_triple - 1], block.pair_of[block.first_triple], block.tokens[block.first_triple].astype(np.int64)
    kept = np.flatnonzero(triple)
    p3 = (triple[kept] + k3 * p2[last[kept]]) / (pair[head[kept]] + k3)
    automaton = Automaton(
        np.concatenate([left[seen] << 32 | right[seen], state_of_pair[head[kept]] << 32 | symbol[kept]]),
        np.log10(np.concatenate([p2[seen], p3])),
        np.concatenate([state_of_pair[seen], state_of_pair[last[kept]]]),
        np.log10(np.concatenate([k2 / (context + k2), k3 / (pair + k3)])),
        np.concatenate([np.full(words + 1, -1), right]),
        np.log10(base),
        np.where(context[:-1] > 0, np.arange(words), -1),
    )
    return automaton, words if context[-1] > 0 else -1


def concentration(contexts: list[int], tokens: list[int], pairs: int) -> float:
    """The k for which sum over contexts of sum over i < c of k / (k + i) is the number of different pairs."""
    sizes = [(n, s / n) for n, s in zip(contexts, tokens, strict=True) if n]

    def expected(k: float) -> float:
        total = 0.0
        for n, c in sizes:
            head = min(int(c), 256)
            total += n * (sum(k / (k + i) for i in range(head)) + k * math.log((k + c) / (k + head)))
        return total

    low, high = 1e-3, 1e7
    for _ in range(60):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if expected(middle) < pairs else (low, middle)
    return low


def score(
    docs: DataFrame,
    train: Column,
    add: float = 0.1,
    block_chars: int = 8_000_000,
    least_blocks: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each of ``docs``: ``id_col``, n_tokens, n_known, train_tokens, base_score, score. The model is learned from
    the rows for which ``train`` holds. A block holds about ``block_chars`` characters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars, rows = docs.agg(F.sum(F.length(text)), F.count(F.lit(1))).first()
    blocks = slots = max(1, -(-(chars or 0) // block_chars), min(least_blocks, rows // 64))
    dealt = docs.select(
        F.col(id_col),
        text.cast("binary").alias("text"),
        F.coalesce(train, F.lit(True)).alias("train"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), text, F.spark_partition_id()), F.lit(blocks)).alias("block"),
    ).repartition(blocks, "block")

    def name(key, group):
        block = Block(group.column("text").to_pylist())
        counts = block.counts(np.repeat(group.column("train").to_numpy(zero_copy_only=False).astype(bool), block.lengths))
        rows = {"slot": [], "block": [], "keys": [], "counts": []}
        for kind in KINDS:
            for slot, part in block.named(kind, slots):
                rows["slot"].append(kind * slots + slot)
                rows["block"].append(key[0].as_py())
                rows["keys"].append(pack_keys(short(block.keys[kind][part])))
                rows["counts"].append(pack_counts(counts[kind][part]))
        return pa.table([pa.array(rows["slot"], pa.int64()), pa.array(rows["block"], pa.int64()), pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary())], names=list(rows))

    def answer(key, group):
        slot = key[0].as_py()
        parts = [unpack_keys(p) for p in group.column("keys").to_pylist()]
        counts = np.concatenate([unpack_counts(c, len(p)) for p, c in zip(parts, group.column("counts").to_pylist(), strict=True)])
        distinct, which = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        seen = totals[totals > 0]
        power = np.frexp(seen)[1]
        contexts = np.bincount(power, minlength=BINS)
        tokens = np.bincount(power, weights=seen, minlength=BINS).astype(np.int64)
        back, at = [], 0
        for part in parts:
            back.append(pack_counts(totals[which[at : at + len(part)]]))
            at += len(part)
        n = len(parts)
        return pa.table(
            [
                pa.array([slot] * (n + 1), pa.int64()),
                pa.array([*group.column("block").to_pylist(), None], pa.int64()),
                pa.array([*back, None], pa.binary()),
                pa.array([None] * n + [contexts.tolist()], pa.list_(pa.int64())),
                pa.array([None] * n + [tokens.tolist()], pa.list_(pa.int64())),
            ],
            names=["slot", "block", "counts", "contexts", "tokens"],
        )

    named = dealt.groupBy("block").applyInArrow(name, "slot long, block long, keys binary, counts binary")
    answers = named.repartition(len(KINDS) * slots, "slot").groupBy("slot").applyInArrow(
        answer, "slot long, block long, counts binary, contexts array<long>, tokens array<long>"
    )
    answers = settle(answers, "model-answers")

    kind = F.floor(F.col("slot") / slots).cast("int").alias("kind")
    bins = answers.filter("block is null").groupBy(kind).agg(
        *(F.array(*(F.sum(F.col(c)[i]) for i in range(BINS))).alias(c) for c in ("contexts", "tokens"))
    )
    totals = {r["kind"]: (r["contexts"], r["tokens"]) for r in bins.collect()}
    words, pairs, triples = (totals.get(k, ([], [])) for k in KINDS)
    n, v = sum(words[1]), sum(words[0])
    k2 = concentration(*words, sum(pairs[0])) if n else 1.0
    k3 = concentration(*pairs, sum(triples[0])) if sum(triples[0]) else 1.0

    def traverse_block(key, group, replies):
        if not group.num_rows:
            return out.empty_table()
        ids = group.column(id_col)
        block = Block(group.column("text").to_pylist())
        by_slot = dict(zip(replies.column("slot").to_pylist(), replies.column("counts").to_pylist(), strict=True))
        counts = {}
        for kind in KINDS:
            counts[kind] = np.zeros(len(block.keys[kind]), dtype=np.int64)
            for slot, part in block.named(kind, slots):
                if kind * slots + slot not in by_slot:
                    raise ValueError("the rows of docs were dealt otherwise when they were read again: pass a table")
                counts[kind][part] = unpack_counts(by_slot[kind * slots + slot], len(part))
        word = counts[WORD]
        base = (word + add) / (n + add * (v + 1))
        automaton, start = build(block, counts, base, k2, k3)
        each = traverse(automaton, block, start)
        total = lambda x: np.add.reduceat(x, block.starts)
        return pa.Table.from_arrays(
            [
                ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids,
                pa.array(block.lengths),
                pa.array(total((word > 0)[block.tokens].astype(np.int64))),
                pa.array(np.full(len(block.lengths), n, dtype=np.int64)),
                pa.array(total(np.log10(base)[block.tokens])),
                pa.array(total(each)),
            ],
            schema=out,
        )

    long, double = T.LongType(), T.DoubleType()
    result = T.StructType(
        [
            docs.schema[id_col],
            *(T.StructField(c, long) for c in ("n_tokens", "n_known", "train_tokens")),
            *(T.StructField(c, double) for c in ("base_score", "score")),
        ]
    )
    out = to_arrow_schema(result)
    replies = answers.filter("block is not null").select("slot", "block", "counts").repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(traverse_block, result)
