"""Jaccard join of texts on word n-grams by a MinHash LSH forest, verified exactly.

Words are runs of letters, digits and underscores, in lower case; a text's set holds its runs of ``words`` words (a shorter
text is one run). Texts of equal words are one class, met once. Each class has a label in every tree of the forest: a byte
for each of its minima, in a fixed order, behind the tree's number. Sorted labels are the tree's trie, and texts that share a prefix of
d bytes are below the same node. Two texts of similarity s share such a node in one of L trees with probability 1 - (1 - s^d)^L.

The matched prefix of a text is shortened from the whole label. The whole label is just as long as the recall
at the threshold allows, so the target recall is reached whatever comes after. A text goes on to a shorter prefix, tree by tree,
as long as no more than ``few`` texts are below the node it comes to: where texts are sparse, shorter prefixes find
links beyond the target at hardly any cost; where they are dense, the prefix stays long. Two texts that share the whole label
share all its prefixes, so they stop at the same node.

Nodes link their texts, and the connected parts of these links are the candidate groups. A group of n texts is compared pair by pair
if it is small or if its nodes propose at least as many pairs as it has; else pairs are compared node by node, and a link counts at
the first node that both texts share. So no more pairs are compared than the forest proposes, but for groups of up to ``whole`` texts.
What is compared as one is cut into chunks of a fixed number of texts and n-grams, each two of which are a piece of work of
fixed size. Pairs are never rows: a piece gives each text its number of links and a root that it is linked to.

Defined results: a null text, or one without a word, is its own class without links; a repeated row is a copy; rows of
the same id and another text are classes of their own; columns other than the id and the text aren't read, so their names
can't clash; ties can't arise, as groups are named by their least id.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, settle, slices
from .components import components

WORDS = re.compile(r"\w+")
#: Words whose hashes a Python worker remembers.
REMEMBERED = 500_000
#: Longer ones, as in texts without blanks, aren't remembered, so that the memory is bounded in bytes.
LONGEST_REMEMBERED = 32
#: Slots that the ids of texts in candidate groups are hashed to; their table is broadcast and holds this many numbers at most.
SLOTS = 1 << 21
#: Bytes of minima that a label has room for, behind the tree's number.
LEVELS = 7


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        found = xxhash.xxh3_64_intdigest(word.encode())
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


def ngrams(words: list[str], n: int, hashes: WordHashes) -> np.ndarray:
    """Hashes of the runs of ``n`` words, with repeats."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    runs = max(1, len(h) - n + 1)
    total = np.full(runs, min(n, len(h)), dtype=np.uint64)
    for k in range(min(n, len(h))):
        total = _mix(total + h[k : k + runs])
    return total


def depth(trees: int, threshold: float, recall: float) -> int:
    """The longest prefix that finds pairs at the threshold with at least this probability."""
    d = 1
    while d < LEVELS and 1 - (1 - threshold ** (d + 1)) ** trees >= recall:
        d += 1
    return d


class Forest:
    """MinHash labels: for each tree its number and ``depth`` bytes, one of each minimum, from the highest to the lowest."""

    def __init__(self, trees: int, depth: int, seed: int = 1):
        if trees > 128:
            raise ValueError("a label has room for 128 trees")
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.a = rng.integers(1 << 31, size=trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1 << 32, size=trees * depth, dtype=np.uint32)

    def labels(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)[:, None]
        least = np.full(self.trees * self.depth, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), 512):
            np.minimum(least, (x[at : at + 512] * self.a + self.b).min(axis=0), out=least)
        bytes_ = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64).reshape(self.trees, self.depth)
        total = np.arange(self.trees, dtype=np.int64)
        for k in range(self.depth):
            total = total << 8 | bytes_[:, k]
        return total


def stops(leaves: DataFrame, deepest: int, shortest: int, few: int) -> DataFrame:
    """(node, leaf, depth) from (node, label): for each text and tree the trie node where it stops, if it shares it. The first
    step, from all labels to those that share a shortest prefix, leaves few; only what is below crowded nodes goes on."""
    found, open_, spent = None, leaves, []
    for d in range(shortest, deepest + 1):
        prefix = F.shiftright("label", 8 * (deepest - d)).alias("prefix")
        open_ = open_.select("node", "label", prefix)
        shared = open_.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = settle(open_.join(shared, "prefix"), "trie-nodes")
        spent.append(met)
        here = met if d == deepest else met.filter(F.col("n") <= few)
        here = here.select("node", F.xxhash64(F.lit(d), "prefix").alias("leaf"), F.lit(d).alias("depth"))
        found = here if found is None else found.union(here)
        open_ = met.filter(F.col("n") > few)
    found = settle(found, "trie-stops")
    release(*spent)
    return found


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Common members of each two sets of distinct hashes."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    grams, column, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = found > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((n, n))
    width = 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (low, low + width))
        part = np.zeros((n, width), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        common += part @ part.T
    np.fill_diagonal(common, [len(s) for s in sets])
    return common


def links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether two sets' similarity is at least the threshold; no set links to itself."""
    common = common_counts(sets)
    size = np.diag(common)
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    return near


def roots(near: np.ndarray) -> np.ndarray:
    """For each node the first node of its connected part."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            root[start], todo = start, [start]
            while todo:
                new = np.flatnonzero(near[todo.pop()] & (root < 0))
                root[new] = start
                todo += new.tolist()
    return root


def join(
    docs: DataFrame,
    words: int = 5,
    threshold: float = 0.8,
    trees: int = 40,
    recall: float = 0.9999,
    few: int = 32,
    whole: int = 256,
    chunk_texts: int = 1024,
    chunk_grams: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each of ``docs``: ``id_col``, text_hash (``xxhash64`` of the text, for rows that share an id), class_id (the least id among all texts it is linked to, over any number of
    links), copy_id (the least id with the same words), n_copies (rows with the same words) and n_links (other texts, not
    counting copies, at the threshold or above). Texts are found by their least id, so those that have null ids alone are
    copies of one another and link to no other text."""
    id_type = docs.schema[id_col].dataType
    deepest = depth(trees, threshold, recall)
    forest = Forest(trees, deepest)
    signed = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("text_hash", T.LongType()),
            T.StructField("key", T.BinaryType()),
            T.StructField("grams", T.IntegerType()),
            T.StructField("labels", T.ArrayType(T.LongType())),
        ]
    )

    def sign(batches):
        hashes = WordHashes()
        for batch in slices(batches):
            keys, grams, labels = [], [], []
            for text in batch.column(1).to_pylist():
                found = WORDS.findall(text.lower()) if text else []
                keys.append(xxhash.xxh3_128_digest(" ".join(found).encode()) if found else None)
                grams.append(max(1, len(found) - words + 1))
                labels.append(forest.labels(ngrams(found, words, hashes)) if found else None)
            columns = [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(grams, pa.int32()), pa.array(labels, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=signed.names)

    rows = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col), F.xxhash64(text_col)).mapInArrow(sign, signed), "signatures")
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("grams").alias("grams"), F.first("labels").alias("labels")
    )
    classes = settle(classes, "text-classes").withColumn("node", F.xxhash64("key"))

    nodes = stops(classes.select("node", F.explode("labels").alias("label")), deepest, max(1, deepest - 1), few).drop("depth")
    sets = nodes.groupBy("leaf").agg(F.min("node").alias("least"), F.bit_xor(F.xxhash64("node")).alias("mark"), F.count(F.lit(1)).alias("n"))
    # nodes with the same texts, of different trees, are one
    sets = sets.groupBy("least", "mark", "n").agg(F.min("leaf").alias("leaf"))
    sets = settle(sets.select("leaf", "least", "n"), "node-sets")
    nodes = settle(nodes.join(sets.select("leaf", "least"), "leaf"), "nodes")
    groups = components(nodes.select(F.col("node").alias("u"), F.col("least").alias("v")), "candidates")

    proposed = sets.join(groups.withColumnRenamed("node", "least"), "least").select("label", "leaf", (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    size = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(proposed.groupBy("label").agg(F.sum("pairs").alias("pairs")), "label")
    size = size.select("label", ((F.col("n") <= whole) | (F.col("pairs") >= F.col("n") * (F.col("n") - 1) / 2)).alias("together"))
    grouped = classes.select("node", "key", "rep", "grams").join(groups, "node").join(size, "label")
    together = grouped.filter("together").select("key", "rep", "grams", F.col("label").alias("unit"), F.lit(None).cast("array<long>").alias("leaves"))
    apart = grouped.filter("not together")
    own = nodes.join(apart.select("node"), "node").groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))
    apart = apart.join(own, "node").select("key", "rep", "grams", F.explode("leaves").alias("unit"), "leaves")
    units = settle(together.union(apart), "units")
    chunks = units.groupBy("unit").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / chunk_texts), F.ceil(F.sum("grams") / chunk_grams)).alias("chunks")
    )
    members = units.join(chunks, "unit").withColumn("chunk", F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks")))
    members = settle(members.select("key", "rep", "unit", "leaves", "chunks", "chunk"), "members")
    release(nodes, sets, groups, units)
    # most texts are in no group: only those whose id falls on a slot of some member's are shuffled
    slot = F.pmod(F.xxhash64("rep"), F.lit(SLOTS)).alias("slot")
    called = F.broadcast(members.select(slot).distinct())
    near = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).withColumn("slot", slot).join(called, "slot", "left_semi")
    texts = members.join(near.drop("slot"), "rep")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    pieces = texts.select("key", "text", "unit", "leaves", "chunk", "chunks", other).select(
        "key",
        "text",
        "unit",
        "leaves",
        "chunks",
        "chunk",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
    )
    amount = members.agg(F.sum("chunks")).first()[0] or 0
    baskets = max(1, -(-amount // 256))
    pieces = pieces.withColumn("basket", F.pmod(F.xxhash64("unit", "i", "j"), F.lit(baskets)))
    found_schema = "key binary, root binary, links long, whole boolean"

    def verify(key, group):
        hashes = WordHashes()
        out = {"key": [], "root": [], "links": [], "whole": []}
        pieces_: dict[tuple, list[tuple]] = defaultdict(list)
        columns = [group.column(c).to_pylist() for c in ("unit", "i", "j", "key", "text", "chunk", "chunks", "leaves")]
        for unit, i, j, *row in zip(*columns, strict=True):
            pieces_[unit, i, j].append(row)
        for (unit, i, j), rows_ in pieces_.items():
            sets, keys, at, leaves = [], [], [], []
            for key_, text, chunk_, _, leaves_ in sorted(rows_, key=lambda r: r[0]):
                found = WORDS.findall(text.lower()) if text else []
                # another row of the representative's id may hold another text, and a repeated row the same one
                if not found or keys and keys[-1] == key_ or xxhash.xxh3_128_digest(" ".join(found).encode()) != key_:
                    continue
                keys.append(key_)
                sets.append(np.unique(ngrams(found, words, hashes)))
                at.append(chunk_)
                leaves.append(leaves_)
            if len(sets) < 2:
                continue
            near = links(sets, threshold)
            if i != j:
                at = np.array(at)
                near &= at[:, None] != at[None, :]
            if leaves[0] is not None:
                first_shared_only(near, leaves, unit)
            degree, root = near.sum(axis=1), roots(near)
            for k in np.flatnonzero(degree).tolist():
                out["key"].append(keys[k])
                out["root"].append(keys[root[k]])
                out["links"].append(int(degree[k]))
                out["whole"].append(rows_[0][3] == 1 and leaves[0] is None)
        types = (pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    found = settle(pieces.groupBy("basket").applyInArrow(verify, found_schema), "links")
    release(members)
    # a group in one piece is settled there; others meet across their pieces
    across = components(found.filter("not whole").select(F.col("key").alias("u"), F.col("root").alias("v")), "linked")
    settled = found.filter("whole").select(F.col("key").alias("node"), F.col("root").alias("label")).union(across)
    linked = settled.join(classes.select(F.col("key").alias("node"), "rep"), "node")
    names = linked.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = linked.join(names, "label").select(F.col("node").alias("key"), "class_id")
    degrees = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    known = classes.select("key", "rep", "copies").join(named, "key", "left").join(degrees, "key", "left")
    known = settle(known, "classes")
    release(found, across)
    # rows without words meet no class: they don't take part in the join, where they would all be one key
    wordless = rows.filter("key is null").select("id", "text_hash", F.lit(None).alias("class_id"), F.lit(None).alias("rep"), F.lit(None).alias("copies"), F.lit(None).alias("n_links"))
    worded = rows.filter("key is not null").select("id", "text_hash", "key").join(known, "key", "left").select("id", "text_hash", "class_id", "rep", "copies", "n_links")
    return worded.union(wordless).select(
        F.col("id").alias(id_col),
        "text_hash",
        F.coalesce("class_id", "rep", "id").alias("class_id"),
        F.coalesce("rep", "id").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def first_shared_only(near: np.ndarray, leaves: list[list[int]], unit: int) -> None:
    """Drop the links of pairs whose first shared node isn't ``unit``: they count there."""
    known = [set(own[: own.index(unit)]) for own in leaves]
    for a in range(len(leaves)):
        if known[a]:
            for b in np.flatnonzero(near[a, a + 1 :]) + a + 1:
                if not known[a].isdisjoint(known[b]):
                    near[a, b] = near[b, a] = False
