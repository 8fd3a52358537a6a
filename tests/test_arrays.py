"""The array source against NumPy."""

import numpy as np
import pytest

from vectrine.sources import arrays as N


def flat(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.name, r.member or "", r.row, r["first"])):
        out.setdefault((r.name, r.member), []).extend(r["values"])
    return out


@pytest.fixture(scope="module")
def held(tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays")
    (root / "deep er").mkdir()
    rng = np.random.default_rng(1)
    arrays = {
        "f4": rng.normal(size=(7, 3, 5)).astype("<f4"), "f8": rng.normal(size=(2, 1000)), "i8": np.arange(-5, 40), "big": np.arange(6, dtype=">i2").reshape(2, 3),
        "b": np.array([[True, False]]), "none": np.zeros((0, 4)), "wide": np.zeros((3, 0)), "one": np.array(4.5), "u": np.array([255], "u1"), "odd": np.array([[1.0, np.nan], [np.inf, 2]]),
    }
    for k, a in arrays.items():
        np.save(root / ("deep er" if k == "f8" else "") / f"{k}.npy", a)
    np.savez(root / "stored.npz", x=arrays["f4"], y=arrays["i8"])
    np.savez_compressed(root / "packed.npz", x=arrays["f4"], y=arrays["f8"])
    return root, arrays


@pytest.mark.parametrize(("chunk", "step"), [(64 << 20, 1 << 16), (700, 4), (3333, 100), (2000, 1)])
def test_values(spark, held, chunk, step):
    root, arrays = held
    rows = N.read_arrays(spark, str(root), chunk=chunk, step=step).collect()
    want = {(k, None): a for k, a in arrays.items()} | {("stored", "x"): arrays["f4"], ("stored", "y"): arrays["i8"], ("packed", "x"): arrays["f4"], ("packed", "y"): arrays["f8"]}
    got = flat(rows)
    assert set(got) == {k for k, a in want.items() if a.size}
    for k, values in got.items():
        np.testing.assert_array_equal(values, want[k].astype(float).ravel())
    assert all(len(r["values"]) <= step for r in rows)
    assert {(r.row, r["first"]) for r in rows if r.name == "f4"} == {(i, j) for i in range(7) for j in range(0, 15, step)}


def test_headers_and_report(spark, held):
    root, arrays = held
    heads = {(r.name, r.member): r for r in N.array_headers(spark, str(root)).collect()}
    for k, a in arrays.items():
        r = heads[k, None]
        assert (np.dtype(r.dtype), tuple(r["shape"]), r.n_values, r.fault) == (a.dtype, a.shape, a.size, None)
    assert heads["packed", "y"]["shape"] == [2, 1000]
    report = {(r.name, r.member): tuple(r)[2:] for r in N.array_report(N.read_arrays(spark, str(root), step=2)).collect()}
    assert report["odd", None] == (2, 4, 2) and report["f4", None] == (7, 105, 0) and report["stored", "y"] == (45, 45, 0)


def test_faults(spark, tmp_path):
    np.save(tmp_path / "pickled.npy", np.array([{}], dtype=object))
    np.save(tmp_path / "columns.npy", np.asfortranarray(np.ones((2, 3))))
    np.save(tmp_path / "text.npy", np.array(["a"]))
    np.save(tmp_path / "short.npy", np.ones(100))
    with open(tmp_path / "short.npy", "r+b") as f:
        f.truncate(500)
    (tmp_path / "no.npy").write_bytes(b"not an array")
    (tmp_path / "no.npz").write_bytes(b"not an archive")
    heads = {(r.name, r.file_bytes): r.fault for r in N.array_headers(spark, str(tmp_path)).collect()}
    assert {k[0]: v.split(":")[0] for k, v in heads.items()} == {"pickled": "pickled objects", "columns": "stored column by column", "text": "no numbers", "short": "ends too soon", "no": "no array"}
    for name in ("pickled", "columns", "text", "short"):
        with pytest.raises(Exception, match=heads[next(k for k in heads if k[0] == name)]):
            N.read_arrays(spark, str(tmp_path), f"{name}.npy").count()
    with pytest.raises(Exception, match="nowhere"):
        N.read_arrays(spark, str(tmp_path / "nowhere")).count()
    (tmp_path / "empty").mkdir()
    assert N.read_arrays(spark, str(tmp_path / "empty")).count() == 0 and N.array_headers(spark, str(tmp_path / "empty")).count() == 0


def test_file_above_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: its header, and its last values by the task that has them."""
    n = 400_000_000
    with open(tmp_path / "large.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": (n // 1000, 1000)})
        begin = f.tell()
        f.truncate(begin + 8 * n)
        f.seek(begin + 8 * (n - 3))
        f.write(np.array([1.0, 2, 3]).tobytes())
    head = N.array_headers(spark, str(tmp_path)).first()
    assert (head["shape"], head.n_values, head.fault) == ([n // 1000, 1000], n, None) and head.file_bytes > 3 << 30 - 1
    reader = N.ValuesReader({"path": str(tmp_path)})
    shares = reader.partitions()
    assert len(shares) == -(-head.file_bytes // N.CHUNK)
    last = [b.to_pylist() for b in reader.read(shares[-1])]
    assert last[-1][-1]["row"] == n // 1000 - 1 and last[-1][-1]["values"][-3:] == [1, 2, 3]
    counts = [sum(b.num_rows for b in reader.read(s)) for s in (shares[0], shares[1], shares[-1])]
    assert all(abs(c - n // 1000 / len(shares)) < 2 for c in counts)


def test_written_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0, -i / 3]) for i in range(1000)], "k long, v array<float>").repartition(3)
    shards = N.write_arrays(rows, f"file://{tmp_path}", "k", "v", rows=100)
    assert shards.agg({"n_rows": "sum"}).first()[0] == 1000 and shards.agg({"n_rows": "max"}).first()[0] == 100
    ids, values = {}, {}
    for p in tmp_path.glob("*.npz"):
        with np.load(p) as a:
            ids[p.stem], values[p.stem] = a["ids"], a["vectors"]
    got = flat(N.read_arrays(spark, str(tmp_path)).collect())
    assert set(got) == {(k, m) for k in ids for m in ("ids", "vectors")}
    for k in ids:
        np.testing.assert_array_equal(got[k, "ids"], ids[k])
        np.testing.assert_array_equal(got[k, "vectors"], values[k].astype(float).ravel())
    contract = {"ids": ("i8", (None,)), "vectors": ("f4", (None, 3))}
    assert all(r.faults == [] for r in N.checked_shards(spark, str(tmp_path), contract).collect())


def test_contract_of_shards(spark, tmp_path):
    np.savez(tmp_path / "good.npz", x=np.ones((2, 3), "f4"))
    np.savez(tmp_path / "rank.npz", x=np.ones(3, "f4"), y=np.ones(1))
    np.savez(tmp_path / "wide.npz", x=np.ones((2, 4), "f4"))
    np.savez(tmp_path / "kind.npz", x=np.ones((2, 3)))
    np.savez(tmp_path / "odd.npz", x=np.array([[1, 2, np.nan]], "f4"))
    np.savez(tmp_path / "lacks.npz", y=np.ones(1))
    np.savez(tmp_path / "objects.npz", x=np.array([{}], dtype=object))
    got = {r.name: r.faults for r in N.checked_shards(spark, str(tmp_path), {"x": ("f4", (None, 3))}).collect()}
    assert got == {
        "good": [], "rank": ["x: is f4:1", "y: not expected"], "wide": ["x: has shape 2x4"], "kind": ["x: is f8:2"], "odd": ["x: not finite"],
        "lacks": ["y: not expected", "x: lacks"], "objects": ["x: pickled objects"],
    }
