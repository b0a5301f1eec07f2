"""What the operators of this subpackage share: table access, shared storage and word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.storage import remove, scope, scratch, shared_dir, stored

#: Six ASCII white-space characters part words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_BATCH = 1000


__all__ = ["SPACES", "WORD", "clean", "crc_of_id", "n_words", "remove", "scope", "scratch", "shared_dir", "small_batches", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_A_BATCH texts in this session: a batch of long texts is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_A_BATCH:
        spark.conf.set(key, ROWS_A_BATCH)


def clean(spark: SparkSession) -> None:
    """Removes every table that :func:`stored` wrote in this application, for results that have been read."""
    remove(spark, shared_dir(spark))


def n_words(text: Column) -> Column:
    """The number of words in ``text``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
