"""Packing of token ids into sequences of a fixed capacity.

A document's ids are cut at every full window, which is a sequence of its own; what is left is cut into small
pieces. Documents are dealt into groups by a hash of their id and their place in the input, so that rows of one id are no group
of their own; each group has a bounded size, and the small pieces of a group
are spread over windows by multiway differencing: partial partitions, each a tuple of window loads, are merged
two at a time, the one with the largest imbalance first, its heaviest window with the other's lightest. That gives
nearly equal loads. The number of windows starts at the least possible and rises while one of them is
over capacity.

Defined results: a null text counts as empty, and holds the closing id alone; repeated rows are packed each;
columns other than the id and the text aren't read, so their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import read_ranks
from .common import slices


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, load of each window). The first partial partitions are runs of as many pieces as
    there are windows, in order of size, so that each merge settles a whole run."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    after = np.full(n, -1)
    heap = []
    for tie, at in enumerate(range(0, n, windows)):
        run = order[at : at + windows]
        loads, first = np.zeros(windows, dtype=np.int64), np.full(windows, -1)
        loads[: len(run)], first[: len(run)] = sizes[run], run
        heap.append((-(loads[0] - loads[-1]), tie, loads, first, first.copy()))
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, loads, first, last = heapq.heappop(heap)
        _, _, loads2, first2, last2 = heapq.heappop(heap)
        loads2, first2, last2 = loads2[::-1], first2[::-1], last2[::-1]
        both = (last >= 0) & (first2 >= 0)
        after[last[both]] = first2[both]
        first, last = np.where(first >= 0, first, first2), np.where(last2 >= 0, last2, last)
        loads = loads + loads2
        by = np.argsort(-loads, kind="stable")
        loads, first, last = loads[by], first[by], last[by]
        heapq.heappush(heap, (-(loads[0] - loads[-1]), tie, loads, first, last))
        tie += 1
    _, _, loads, first, _ = heap[0]
    window = np.empty(n, dtype=np.int64)
    here, at = first.copy(), np.arange(windows)
    while (alive := here >= 0).any():
        here, at = here[alive], at[alive]
        window[here] = at
        here = after[here]
    return window, loads


def spread(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece, such that none holds more than ``capacity``."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, loads = difference(sizes, windows)
        if loads.max() <= capacity:
            return window
        windows += max(1, windows // 200)


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    capacity: int = 1024,
    grain: int = 128,
    docs_per_group: int = 1024,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece: the document, where the piece starts in its ids, its length and checksum, the
    document's ids, and its sequence and place there. ``grain`` is the longest piece of a document's last, partly
    filled window. A group holds about ``docs_per_group`` documents, so that its task needs the same memory at any input size."""
    ranks = read_ranks(ranks_path)
    groups = max(1, -(-docs.count() // docs_per_group))
    id_type = docs.schema[id_col].dataType
    long = T.LongType()
    cut = T.StructType(
        [
            T.StructField(id_col, id_type),
            *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "group")),
        ]
    )
    closing = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        import tiktoken

        #: The same ids as the library ``tokenizers`` gives for the same vocabulary, in a sixth of the time.
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in slices(batches):
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.asarray(encoding.encode_to_numpy(text), dtype="<u4").tobytes() + closing
                total = len(ids) // 4
                full = total // capacity * capacity
                bounds = [*range(0, full, capacity), *range(full, total, grain), total]
                for a, b in zip(bounds, bounds[1:], strict=False):
                    rows.append(row)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[4 * a : 4 * b]))
                    totals.append(total)
            took = pa.array(rows, pa.int64())
            values = [batch.column(0).take(took), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            yield pa.RecordBatch.from_arrays([*values, batch.column(2).take(took)], names=cut.names)

    packed = T.StructType([*cut.fields[:-1], T.StructField("sequence_id", long), T.StructField("offset", long)])

    def windows(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([id_col, "start", "ids_crc32"], kind="stable", ignore_index=True)
        sizes = group["length"].to_numpy()
        small = sizes < capacity
        window = np.empty(len(group), dtype=np.int64)
        window[~small] = np.arange((~small).sum())
        if small.any():
            window[small] = (~small).sum() + spread(sizes[small], capacity)
        group["sequence_id"] = (group["group"].iloc[0] << 32) + window
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group[packed.names]

    rows = docs.select(
        F.col(id_col),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(groups)).alias("group"),
    )
    return rows.mapInArrow(pieces, cut).groupBy("group").applyInPandas(windows, packed)
