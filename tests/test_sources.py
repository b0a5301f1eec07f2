import json

import numpy as np
import pytest

from halyard.errors import Corrupt, InvalidInput
from halyard.sources import bodies, matrices, synthetic


@pytest.mark.parametrize("name, type_", [("a.npy", "<f4"), ("a.npy", "<i4"), ("a.npy", "<i8"), ("a.fvecs", "<f4"), ("a.ivecs", "<i4")])
def test_round_trip(spark, tmp_path, name, type_):
    rows = np.arange(12).reshape(4, 3)
    kind = "array<float>" if type_ == "<f4" else "array<long>"
    df = spark.createDataFrame([(i, r.tolist() if type_ != "<f4" else [float(x) for x in r]) for i, r in enumerate(rows)], f"row long, vector {kind}")
    path = str(tmp_path / name)
    assert matrices.save_matrix(df, path, type_=type_) == 4
    got = matrices.read_matrix(spark, path).orderBy("row").collect()
    assert [list(r["vector"]) for r in got] == rows.tolist()
    if name == "a.npy":
        assert np.load(path).tolist() == rows.tolist()


def test_damaged_files(tmp_path):
    path = str(tmp_path / "a.npy")
    np.save(path, np.zeros((3, 2), np.float32))
    matrices.npy_shape(path)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(Corrupt):
        matrices.npy_shape(path)
    for bad in (np.zeros((2, 2), np.float64), np.asfortranarray(np.zeros((2, 3), np.float32)), np.zeros((2, 2, 2), np.float32)):
        np.save(path, bad)
        with pytest.raises(Corrupt):
            matrices.npy_shape(path)
    vecs = tmp_path / "a.fvecs"
    vecs.write_bytes(np.array([2, 0, 0, 2, 0], "<i4").tobytes())
    with pytest.raises(Corrupt):
        matrices.vecs_shape(str(vecs), "<f4")
    with pytest.raises(InvalidInput):
        matrices.kind_of("a.csv")


def test_ids(spark, tmp_path):
    path = str(tmp_path / "ids.npy")
    np.save(path, np.array([5, 9], np.int64))
    assert [tuple(r) for r in matrices.read_ids(spark, path).orderBy("row").collect()] == [(0, 5), (1, 9)]
    np.save(path, np.array([5, -9], np.int64))
    with pytest.raises(InvalidInput):
        matrices.read_ids(spark, path)


def test_request_bodies(spark):
    good = json.dumps({"upsert": True, "vectors": [{"id": 1, "vector": [0.5, -1e3]}, {"id": 2, "vector": [1, 2]}]})
    df = bodies.json_vectors(spark.createDataFrame([(good,)], "body string"))
    assert [(r["upsert"], r["id"], list(r["vector"])) for r in df.collect()] == [(True, 1, [0.5, -1000.0]), (True, 2, [1.0, 2.0])]
    with pytest.raises(InvalidInput):
        bodies.json_vectors(spark.createDataFrame([('{"vectors": [], "more": 1}',)], "body string"))
    packed = bodies.pack(np.array([3, 4]), np.array([[1, 2], [3, 4]]))
    got = bodies.packed_vectors(spark.createDataFrame([(bytearray(packed),)], "content binary")).collect()
    assert [(r["id"], list(r["vector"])) for r in got] == [(3, [1.0, 2.0]), (4, [3.0, 4.0])]
    for bad in (packed[:-1], b"XXXX" + packed[4:], b""):
        with pytest.raises(InvalidInput):
            bodies.unpack(bad)


def test_synthetic_is_seeded(spark):
    spec = synthetic.Mixture(3, clusters=2)
    a = [list(r["vector"]) for r in synthetic.synthetic(spark, spec, 5).collect()]
    assert a == [x.tolist() for x in spec.rows(5)] and a[:2] == [x.tolist() for x in spec.rows(2)]
    u = np.array([r["vector"] for r in synthetic.uniform(spark, 4, 200).collect()])
    assert u.min() >= -1 and u.max() < 1 and abs(u.mean()) < 0.1
    with pytest.raises(InvalidInput):
        synthetic.Mixture(0)
