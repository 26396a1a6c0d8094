"""Language identification by the nearest of several centroids a language.

A text becomes hashed counts of one to three neighbouring bytes of its lower-case letters, damped by a logarithm, weighted
by inverse document frequency and scaled to length one. For each language, spherical k-means over a bounded sample of
labelled texts gives a few centroids. A text gets the language of the nearest centroid by cosine, and is rejected if it is
farther from it than that language's texts are. The model (languages x clusters x dimensions floats) is small and travels
with the task; only the label of the sampled rows is ever read, never a label at prediction.

Defined results: a null text, or one without a letter, gets ``und``, score 0, and is rejected; so does every text where
nothing was learned. Ties go to the first language by name. Repeated rows give repeated rows; columns other than the
named ones aren't read, so their names can't clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, settle, slices

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def counts(text: str | None, dimensions: int) -> np.ndarray | None:
    """Damped counts of the hashed byte n-grams; None without a letter."""
    if not text:
        return None
    letters = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters)):  # signs such as superscripts are no letters
        return None
    b = np.frombuffer(f" {letters} ".encode(), dtype=np.uint8).astype(np.uint32)
    total = np.zeros(dimensions)
    gram = b
    for n in range(3):
        if n:
            gram = gram[:-1] << np.uint32(8) | b[n:]
        bucket = ((gram + np.uint32(n * 0x1E3779B1)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - dimensions.bit_length() + 1)
        total += np.bincount(bucket, minlength=dimensions)
    seen = total > 0
    total[seen] = 1 + np.log(total[seen])
    return total


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def spherical_kmeans(x: np.ndarray, clusters: int, seed: int = 7, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    while len(centres) < clusters:
        far = np.clip(1 - (x @ centres.T).max(axis=1), 0, None)
        if far.max() < 1e-9:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[nearest == k].sum(axis=0) if (nearest == k).any() else c for k, c in enumerate(centres)]))
    return centres


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    floor: np.ndarray
    idf: np.ndarray


def fit(
    docs: DataFrame,
    learn: Column,
    sample_per_language: int = 1000,
    clusters: int = 4,
    dimensions: int = 8192,
    slack: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learn from at most ``sample_per_language`` rows of each language, taken by a hash, among the rows for
    which ``learn`` holds. ``dimensions`` is a power of two. A text is rejected below ``slack`` times the similarity that 99.5 %
    of the sampled texts of the language reach."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # a row's number, in [0, 1), is fixed by its id, text and label; of each language about twice the rows wanted go on to be ranked
    number = F.pmod(F.xxhash64(id_col, lang_col, text_col), F.lit(1 << 30)) / (1 << 30)
    amounts = rows.groupBy(lang_col).agg((2.0 * sample_per_language / F.count(F.lit(1)) + 1e-9).alias("below"), F.count(F.lit(1)).alias("of"))
    drawn = rows.select(lang_col, text_col, number.alias("number")).join(F.broadcast(settle(amounts, "language-amounts")), lang_col)
    drawn = settle(drawn.filter((F.col("of") <= 2 * sample_per_language) | (F.col("number") < F.col("below"))).select(lang_col, text_col, "number").distinct(), "language-draw")
    order = Window.partitionBy(lang_col).orderBy("number", text_col)
    chosen = drawn.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= sample_per_language)
    sample = settle(chosen.select(lang_col, text_col), "language-sample")
    release(drawn)

    def frequencies(group: pd.DataFrame) -> pd.DataFrame:
        found, texts = np.zeros(dimensions, dtype=np.int64), 0
        for text in group[text_col]:
            if (v := counts(text, dimensions)) is not None:
                found += v > 0
                texts += 1
        return pd.DataFrame({"texts": [texts], "found": [found]})

    by_language = sample.groupBy(lang_col).applyInPandas(frequencies, "texts long, found array<long>").collect()
    if not by_language:
        return Model([], np.zeros((0, dimensions)), np.zeros(0), np.ones(dimensions))
    texts = sum(r["texts"] for r in by_language)
    found = sum(np.asarray(r["found"]) for r in by_language)
    idf = np.log((1 + texts) / (1 + found)) + 1

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        x = [v for text in group[text_col] if (v := counts(text, dimensions)) is not None]
        if not x:
            return pd.DataFrame({"lang": [], "centroid": [], "floor": []})
        x = _unit(np.stack(x).astype(np.float32) * idf.astype(np.float32))
        centres = spherical_kmeans(x, clusters)
        floor = float(np.quantile((x @ centres.T).max(axis=1), 0.005)) * slack
        return pd.DataFrame({"lang": group[lang_col].iloc[0], "centroid": list(centres), "floor": floor})

    learned = sample.groupBy(lang_col).applyInPandas(centroids, "lang string, centroid array<float>, floor double").collect()
    learned.sort(key=lambda r: r["lang"])
    return Model(
        [r["lang"] for r in learned],
        np.array([r["centroid"] for r in learned], dtype=np.float32).reshape(-1, dimensions),
        np.array([r["floor"] for r in learned]),
        idf,
    )


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``id_col``, ``lang_pred``, ``score`` (cosine to the nearest centroid) and ``rejected``."""
    schema = T.StructType(
        [
            docs.schema[id_col],
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    judge = _judge(model)

    def run(batches):
        for batch in slices(batches, 256):
            names, scores, rejected = judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text isn't rejected."""
    judge = _judge(model)

    def run(batches):
        for batch in slices(batches, 256):
            _, _, rejected = judge(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judge(model: Model):
    dimensions = len(model.idf)

    def judge(texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if not model.languages:
            return names, scores, rejected
        vectors = [(i, v) for i, t in enumerate(texts) if (v := counts(t, dimensions)) is not None]
        if vectors:
            x = _unit((np.stack([v for _, v in vectors]) * model.idf).astype(np.float32))
            likeness = x @ model.centroids.T
            for (i, _), best, row in zip(vectors, likeness.argmax(axis=1), likeness, strict=True):
                names[i], scores[i] = model.languages[best], float(min(1.0, max(0.0, row[best])))
                rejected[i] = bool(row[best] < model.floor[best])
        return names, scores, rejected

    return judge
