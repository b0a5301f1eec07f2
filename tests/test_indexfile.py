import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.config import CollectionConfig, GraphParams
from halyard.errors import Corrupt, InvalidInput, Unsupported
from halyard.operators import graph
from halyard.operators.collection import ROWS
from halyard.sources import indexfile
from halyard.sources.indexfile import crc32c, inspect, read_index, write_index


def rows_of(spark, n, dim, gone=()):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, 100 + 3 * i, rng.integers(-8, 9, dim).astype(float).tolist(), i in gone) for i in range(n)], ROWS)


def plain_crc(data):
    x = 0xFFFFFFFF
    for b in data:
        x ^= b
        for _ in range(8):
            x = (x >> 1) ^ (0x82F63B78 if x & 1 else 0)
    return x ^ 0xFFFFFFFF


def test_checksums_bit_by_bit():
    rng = np.random.default_rng(1)
    assert crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert crc32c(data) == plain_crc(data)
        assert crc32c(data[n // 3 :], crc32c(data[: n // 3])) == plain_crc(data)


@pytest.fixture(scope="module")
def flat(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "flat")
    config = CollectionConfig(4, "l2")
    rows = rows_of(spark, 200, 4, gone={3, 10, 150})
    write_index(rows, config, path)
    return path, config, rows


def test_rows_come_back(spark, flat):
    path, config, rows = flat
    meta, again, g = read_index(spark, path)
    assert (meta.config.dim, meta.rows, meta.live, g) == (4, 200, 197, None)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows.collect()))
    assert open(path, "rb").read()[:8] == b"VFIDX\r\n\x1a"


def test_every_damage_is_found(spark, flat, tmp_path):
    whole = open(flat[0], "rb").read()
    rng, path = np.random.default_rng(2), str(tmp_path / "damaged")

    def raises(data, kind=(Corrupt, Unsupported)):
        open(path, "wb").write(data)
        with pytest.raises(kind):
            inspect(path)

    for at in rng.choice(len(whole), 60, replace=False):
        raises(whole[:at] + bytes([whole[at] ^ 1 << int(rng.integers(0, 8))]) + whole[at + 1 :])
    for n in (0, 10, 63, 64, 500, len(whole) - 1):
        raises(whole[:n])
    raises(whole + b"\0")
    raises(whole[:12] + b"\x01\x02\x03\x04" + whole[16:], Unsupported)
    raises(whole[:8] + b"\x02\0" + whole[10:], Unsupported)
    vectors = inspect(flat[0])[1][indexfile.VECTORS][0]
    open(path, "wb").write(whole[: vectors + 2] + bytes([whole[vectors + 2] ^ 1]) + whole[vectors + 3 :])
    inspect(path, "metadata")  # vectors are not read at this level
    with pytest.raises(InvalidInput):
        inspect(path, "some")


@pytest.mark.parametrize("n", [0, 1, 60])
def test_graphs_come_back_to_the_byte(spark, tmp_path, n):
    config = CollectionConfig(3, "ip", index="hnsw", graph=GraphParams(m=2, ef_construction=8, ef_search=16, max_level=4, seed=7, shards=1))
    rows = rows_of(spark, n, 3)
    g = graph.build(rows, config)
    paths = [str(tmp_path / x) for x in "ab"]
    write_index(rows, config, paths[0], g, creator="me", created_ms=5)
    meta, again, h = read_index(spark, paths[0])
    assert (meta.creator, meta.created_ms, meta.config.graph.m, meta.config.graph.seed) == ("me", 5, 2, 7)
    write_index(again, meta.config, paths[1], h, meta.creator, meta.created_ms)
    assert open(paths[0], "rb").read() == open(paths[1], "rb").read()
    if n:
        assert [r["bytes"] for r in graph.canonical(g, config.graph).collect()] == [r["bytes"] for r in graph.canonical(h, config.graph).collect()]


def test_what_a_file_cannot_hold(spark, tmp_path):
    rows, path = rows_of(spark, 40, 3), str(tmp_path / "x")
    two = CollectionConfig(3, index="hnsw", graph=GraphParams(m=4, ef_construction=8, shards=2))
    with pytest.raises(InvalidInput):
        write_index(rows, two, path, graph.build(rows, two))
    with pytest.raises(InvalidInput):
        write_index(rows, two, path)
    write_index(rows.withColumn("id", F.lit(5).cast("long")), CollectionConfig(3), path)
    with pytest.raises(Corrupt):
        read_index(spark, path)  # an id twice
