"""Importance resampling towards a target distribution, over hashed n-grams of words.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. The features of a text are all runs of 1 to ``n``
consecutive words; each falls into one of ``buckets`` buckets. A bucket's gain says how much likelier it is in the target
than in the documents; a document's weight is the sum of its features' gains, and the documents with the highest weight plus
Gumbel noise are drawn, which samples without replacement in proportion to the exponent of the weights.

Long texts are cut at word boundaries into chunks that are dealt out anew, so that no task gets a long text whole: a chunk owns
the features that start in it, and carries the ``n - 1`` words after its end for those that reach beyond. What chunks count
is summed by document. The corpus is read twice, once for the counts of the buckets (each task sends one count a bucket at most) and once
for the weights. Ranks are places in a table sorted by range, so that no task sees all rows: each part numbers its own rows,
and the sums of the parts before it are added.

Defined results: a null text has no words, and neither has an empty one, so weight and number of features are 0; a null id is hashed as empty text and
comes last among ties; rows of one id and one text are one group until the end, then each is a row with a rank of its own; rows of one id and
several texts are documents of their own, and of equal scores and ids the one whose text has the smaller hash is first;
a word longer than a chunk isn't cut; with fewer documents than a draw needs, or none, nothing is drawn and all ranks are null; other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_TABLE_SQL, crc_sql, settle, slices

#: What isn't a letter, a digit or part of a character beyond ASCII becomes a blank; capitals A-Z become small.
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_PLAIN = bytearray(bytes(range(256)).lower())
for _x in _SEPARATORS:
    _PLAIN[_x] = 0x20

_LONG = T.LongType()


def cut(data: bytes, size: int, carry: int):
    """(owned part, the ``carry`` words after it) for each chunk of a text whose separators are blanks; parts end before a blank."""
    at = 0
    while True:
        end = data.find(b" ", at + size) if at + size < len(data) else -1
        if end < 0:
            yield data[at:], b""
            return
        reach = end
        for _ in range(carry):  # over the blanks, then over the word
            while reach < len(data) and data[reach] == 0x20:
                reach += 1
            blank = data.find(b" ", reach)
            reach = blank if blank >= 0 else len(data)
        yield data[at:end], data[end:reach]
        at = end


class _Buckets:
    """Buckets of runs of words; those of short words are remembered, so many at most."""

    def __init__(self, n: int, buckets: int, remembered: int = 100_000):
        self.n, self.buckets, self.remembered, self.known = n, buckets, remembered, {}

    def of_word(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            found = zlib.crc32(word) % self.buckets
            if len(word) <= 64:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[word] = found
        return found

    def of_chunk(self, owned: bytes, carried: bytes) -> tuple[int, np.ndarray]:
        """The number of owned words, and the bucket of each run that starts at one of them."""
        words = owned.split()
        found = [self.of_word(w) for w in words]
        if self.n > 1:
            reach = words + carried.split()
            for k in range(2, self.n + 1):
                runs = range(min(len(words), len(reach) - k + 1))
                found += [zlib.crc32(b" ".join(reach[i : i + k])) % self.buckets for i in runs]
        return len(words), np.array(found, dtype=np.int64)


def _chunks(texts: DataFrame, size: int, carry: int) -> DataFrame:
    """id, key, first (whether it's the text's first chunk), owned, carried. Texts of one chunk stay where they are read."""
    at = {name: i for i, name in enumerate(texts.columns)}
    schema = T.StructType(
        [
            *texts.schema.fields[:2],
            T.StructField("chunk", T.IntegerType()),
            T.StructField("owned", T.BinaryType()),
            T.StructField("carried", T.BinaryType()),
        ]
    )

    def parts(batches):
        for batch in slices(batches, 16):
            for row in range(batch.num_rows):
                data = batch.column(at["text"])[row].as_py().encode().translate(bytes(_PLAIN))
                kept = [batch.column(i).slice(row, 1) for i in (0, 1)]
                for chunk, (owned, carried) in enumerate(cut(data, size, carry)):
                    values = [*kept, pa.array([chunk], pa.int32()), pa.array([owned], pa.binary()), pa.array([carried], pa.binary())]
                    yield pa.RecordBatch.from_arrays(values, names=schema.names)

    whole = F.octet_length("text") <= size
    short = texts.filter(whole).select(*texts.columns[:2], F.lit(0).alias("chunk"), F.col("text").cast("binary").alias("owned"), F.lit(b"").alias("carried"))
    long = texts.filter(~whole).mapInArrow(parts, schema)
    return short.union(long.repartition("key", "chunk"))


def bucket_counts(texts: DataFrame, n: int, buckets: int, chunk_bytes: int) -> DataFrame:
    """bucket, hits: how often each bucket is hit by a feature of some text. A task sends each bucket once at most."""

    def hits(batches):
        of, total = _Buckets(n, buckets), np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for owned, carried in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(of.of_chunk(owned.translate(bytes(_PLAIN)), carried)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "hits"])

    parts = _chunks(texts, chunk_bytes, n - 1).select("owned", "carried")
    return parts.mapInArrow(hits, "bucket long, hits long").groupBy("bucket").agg(F.sum("hits").alias("hits"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths: ``buckets`` whole numbers, which is all that reaches the driver."""

    def filled(counted: DataFrame) -> list[int]:
        found = [0] * buckets
        for row in counted.collect():
            found[row["bucket"]] = row["hits"]
        return found

    s, t = filled(docs), filled(target)
    all_s, all_t = sum(s), sum(t)
    return np.array(
        [math.floor(1000 * math.log(float(y + 1) * (all_s + buckets) / (float(x + 1) * (all_t + buckets)))) for x, y in zip(s, t, strict=True)],
        dtype=np.int64,
    )


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the hash of the id and the seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def numbered(rows: DataFrame, copies: str, *order: Column) -> DataFrame:
    """``rows`` in ``order``, each standing for ``copies`` rows: ``before`` counts the rows ahead of it, ``total`` all."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    at = ordered.columns.index(copies)
    schema = T.StructType([*ordered.schema.fields, T.StructField("ahead", _LONG)])

    def ahead(batches):
        so_far = 0
        for batch in batches:
            n = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = so_far + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - n, pa.int64())], names=schema.names)
            so_far = int(upto[-1]) if len(upto) else so_far

    placed = settle(ordered.mapInArrow(ahead, schema), "resampling-order")
    sums = placed.groupBy("part").agg(F.sum(copies).alias("own"))  # a row a part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "part",
        F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"),
        F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    return placed.join(offsets, "part").withColumn("before", F.col("offset") + F.col("ahead")).drop("part", "offset", "ahead")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    chunk_bytes: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: its id, n_features, weight, score and rank. Of the documents with ``least_words`` words or more,
    ``percent`` in a hundred (rounded down) are drawn; their ranks count from 1, the others' are null."""

    def texts(df: DataFrame, id_of: Column, col: str) -> DataFrame:
        text = F.coalesce(F.col(col), F.lit(""))
        return df.select(id_of.alias("id"), F.xxhash64(text, F.octet_length(text)).alias("key"), text.alias("text"))

    ours, theirs = texts(docs, F.col(id_col), text_col), texts(target, F.lit(0), target_text_col)
    gain = gains(*(bucket_counts(x, n, buckets, chunk_bytes) for x in (ours, theirs)), buckets)

    weighed = T.StructType([*ours.schema.fields[:2], *(T.StructField(c, _LONG) for c in ("first", "words", "features", "weight"))])

    def weigh(batches):
        of = _Buckets(n, buckets)
        for batch in slices(batches):
            words, features, weights = [], [], []
            for owned, carried in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                count, found = of.of_chunk(owned.translate(bytes(_PLAIN)), carried)
                words.append(count)
                features.append(len(found))
                weights.append(int(gain[found].sum()))
            first = [int(c == 0) for c in batch.column(2).to_pylist()]
            values = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (first, words, features, weights))]
            yield pa.RecordBatch.from_arrays(values, names=weighed.names)

    parts = _chunks(ours, chunk_bytes, n - 1).mapInArrow(weigh, weighed)
    per_copy = (F.expr(f"sum({c}) div sum(first)").alias(c) for c in ("words", "features", "weight"))  # equal copies have equal sums
    summed = parts.groupBy("id", "key").agg(F.sum("first").alias("copies"), *per_copy)
    scored = settle(summed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "resampling-scores")

    order = (F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("key"))
    place = numbered(scored.filter(F.col("words") >= least_words), "copies", *order)
    drawn = F.floor(F.lit(percent) * F.col("total") / 100)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    ranked = place.select("*", each).withColumn("rank", F.col("before") + F.col("copy"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(F.col("words") < least_words).select("*", each, F.lit(None).cast("long").alias("rank"))
    columns = [F.col("id").alias(id_col), F.col("features").alias("n_features"), "weight", "score", "rank"]
    return ranked.select(*columns).union(rest.select(*columns))


def oracle() -> str:
    """SQL for DuckDB that gives what ``resample`` gives for ``documents`` and ``benchmark``."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH {CRC_TABLE_SQL},
    d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
    b AS (SELECT {words} AS words FROM benchmark),
    dw AS (SELECT r, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
    bucket AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
    s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (w) GROUP BY 1),
    t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY 1),
    gain AS (
        SELECT w, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
            / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
        FROM bucket LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    weighed AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM dw JOIN gain USING (w) GROUP BY 1),
    scored AS (
        SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM d LEFT JOIN weighed USING (r)),
    placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT scored.doc_id, scored.n_features, scored.weight, scored.score, CASE WHEN place <= n // 10 THEN place END AS rank
    FROM scored LEFT JOIN placed USING (r)
    """
