"""From raw documents to packed sequences: quality, line templates, near copies, mix, packing."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import remove, scope, scratch, stored
from halyard.llm.line_templates import drop_passages, drop_templates
from halyard.llm.mixing import mix_texts
from halyard.llm.ngram_join import keep_one_of_each
from halyard.llm.packing import pack_documents
from halyard.llm.quality import judge


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs``, and all its columns as one, so that no name meets an operator's own."""
    return docs.select(*columns, F.struct(*docs.columns).alias("_row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts fail them; null ids and repeated rows are judged like others; an empty table gives none.
    """
    return judge(_packed(docs, "text"), ["_row"]).where("kept").select("_row.*")


def _cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    """The packed rows with their texts as cleaned; those of nothing else go, since the lines stay in the first."""
    df = df.where("dropped is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    n = F.when(F.col("dropped").isNull(), F.col("_row.n_chars")).otherwise(F.char_length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": n.alias("n_chars")}
    return df.select(*(new.get(c, F.col(f"_row.`{c}`")) for c in columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; passages of two documents stay, as near copies are known by them.

    Documents of which nothing is left go. Null texts stay; null ids are told apart by text; repeated rows lose the
    same lines; an empty table gives none.
    """
    return _cleaned(drop_templates(_packed(docs, "doc_id", "text"), passages=False), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles link at 0.8 or more, each passage in one of these only.

    One of equal rows stays, and one of equal texts without ids; null, empty and blank texts all stay; an empty
    table gives none.
    """
    with scratch(spark) as keep:
        left = keep(stored(keep_one_of_each(docs, n=5, percent=80)))
    return _cleaned(drop_passages(_packed(left, "doc_id", "text")), docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time in part.

    Texts without words, null ones too, are not taken; null sources are a source; repeated rows are rows like
    others; an empty table gives none.
    """
    return mix_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is its end token; null ids and repeated rows are packed like others; an empty table
    gives none.
    """
    return pack_documents(docs)


#: The number of the last stage that ran, and the tables that it stored for itself.
_spent: list = [-1, []]


def _stage(number: int, function):
    """``function``, which first removes what the stage before stored for itself, as that stage's result has been written.

    Tables that ``docs`` still reads stay, and so do those of a stage that is not followed by the next.
    """

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before, tables = _spent
        if before == number - 1 and tables:
            read = docs.inputFiles()
            for path in tables:
                if not any(path.rpartition("/")[2] in f for f in read):
                    remove(spark, path)
        with scope() as made:
            found = function(spark, docs, sf_dir)
        _spent[:] = number, made
        return found

    return run


_FUNCTIONS = (("quality", quality), ("line_dedup", line_dedup), ("near_copies", near_copies), ("source_mix", source_mix), ("packing", packing))
STAGES = [(name, _stage(k, f)) for k, (name, f) in enumerate(_FUNCTIONS)]

#: SQL can't express the template tree, the schedule or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        df = stored(stage(spark, df, sf_dir))
    return STAGES[-1][1](spark, df, sf_dir)
