import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions import kernels, random, vectors
from halyard.functions.random import Xoshiro

#: Published first outputs of the generators.
SPLITMIX_1234567 = 6457827717110365317
XOSHIRO_42 = [1546998764402558742, 6990951692964543102, 12544586762248559009, 17057574109182124193, 18295552978065317476]


def test_generators_match_published_values():
    assert random.splitmix64(1234567) == SPLITMIX_1234567
    assert int(random.splitmix64(np.array([1234567], np.uint64))[0]) == SPLITMIX_1234567
    rng = Xoshiro(42)
    assert [rng.bits() for _ in range(5)] == XOSHIRO_42


def test_levels_match_pinned_values():
    got = random.levels(np.arange(100_000), 0x5EEDF0A6E, 16, 16)
    assert [int(np.argmax(got >= k)) for k in (1, 2, 3)] == [37, 38, 3149]
    assert int(got.sum()) == 6588


def test_below_is_in_range_and_between_is_half_open():
    rng = Xoshiro(7)
    assert {rng.below(3) for _ in range(100)} == {0, 1, 2}
    assert all(-1 <= rng.between(-1, 1) < 1 for _ in range(100))


@pytest.mark.parametrize("mode", ["l2", "ip", "cosine_unit", "l2_unit", "ip_unit"])
def test_expressions_and_kernels_agree_bit_for_bit(spark, mode):
    rng = np.random.default_rng(3)
    v, q = rng.standard_normal((40, 24)).astype(np.float32), rng.standard_normal((5, 24)).astype(np.float32)
    inverse = kernels.inverse_norm(q)
    expected = kernels.scores(mode, q, inverse, v)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, vector array<float>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid int, query array<float>")
    d = vectors.score(mode, F.col("query"), vectors.inverse_norm(F.col("query")), F.col("vector"))
    got = asked.crossJoin(rows).select("qid", "id", d.alias("d")).collect()
    assert all(np.float32(r["d"]) == expected[r["qid"], r["id"]] for r in got)


def test_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="differ in length"):
        df.select(vectors.dot(F.col("a"), F.col("b"))).collect()


def test_zero_vectors_have_no_unit_length(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "a array<float>")
    got = [r[0] for r in df.select(vectors.normalize(F.col("a"))).collect()]
    assert got[0] is None and got[1] == pytest.approx([0.6, 0.8])


def test_smallest_breaks_ties_by_order():
    d = np.array([[1, 0, 1, 1, 0]], np.float32)
    _, c = kernels.smallest(d, np.array([4, 3, 2, 1, 0]), 3)
    assert c.tolist() == [4, 1, 3]
