import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(k, seed=0):
    """Invented words, k of them, by a rule."""
    parts = ["ka", "lo", "mi", "ten", "ra", "su", "vel", "or", "dan", "pe"]
    out = []
    for i in range(k):
        h = zlib.crc32(f"{seed} {i}".encode())
        out.append("".join(parts[h >> (4 * j) & 7] for j in range(1 + h % 4)))
    return out


@pytest.fixture(scope="session")
def make(spark):
    def make(rows):
        """Documents from (doc_id, text, source) or (doc_id, text, source, lang)."""
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2], None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward(spark, make):
    """Nulls in every column, empty and blank texts, a long one, repeated rows and ids, odd characters, clashing columns."""
    long_text = " ".join(words(30_000, 9))
    rows = [
        (1, " ".join(words(80, 1)) + ".", "a"),
        (2, " ".join(words(80, 1)) + ".", "a"),
        (2, " ".join(words(80, 1)) + ".", "a"),
        (3, None, "b"),
        (4, "", "b"),
        (5, " \n\t ", None),
        (None, "one two three", "c"),
        (6, long_text, "a"),
        (7, "x" * 50_000, "c"),
        (8, "日本語 テスト\r\nnaïve <|endoftext|> ▁ 😀", "c", None),
        (9, "word", None),
        (None, None, None, None),
    ]
    df = make(rows)
    for c in ("n", "size", "row", "start", "source_size", "bucket", "t", "w", "c", "line", "pos", "tie", "root", "kept", "dropped", "n_lines", "mix_key", "mix_size", "key", "copy", "cut", "words"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)
