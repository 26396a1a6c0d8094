"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, shared_dir

#: Session setting that lets Spark delete the shuffle files of a finished SQL execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that were written and not yet deleted, of this application.
_written: set[str] = set()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: this cuts the lineage, survives lost executors,
    and frees the shuffle files that were needed to make it. What isn't released earlier is deleted when the application ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/stationlake/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_release_all)
    _written.add(path)
    return path


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path in _written:
            _written.discard(path)
            delete(df.sparkSession, path)


def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    while _written:
        delete(spark, _written.pop())


def remainder_of_id(col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``: the folds that the queries fix."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of at most ``rows`` rows, so that Python holds few long texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: SQL for DuckDB: the table of the CRC-32 of IEEE 802.3, as a CTE made by its rule.
CRC_TABLE_SQL = """crc_table AS (
        SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
            lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS crc_of FROM range(256) AS bytes(i))"""


def crc_sql(text: str) -> str:
    """SQL for DuckDB: crc32 of a text's UTF-8 bytes, where ``crc_table`` is joined."""
    code = f"hex(encode({text}))"
    digit = "strpos('0123456789ABCDEF', substr({code}, {at}, 1)) - 1"
    byte = f"(({digit.format(code=code, at='p')}) * 16 + {digit.format(code=code, at='p + 1')})::UBIGINT"
    step = "xor(a >> 8, crc_of[1 + (xor(a, c) & 255)::INTEGER])"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len({code}), 2), lambda p: {byte})), lambda a, c: {step}), 4294967295::UBIGINT)"
