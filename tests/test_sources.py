import math
import struct

import pytest

from pyspark.sql import functions as F

from ridgeline.functions import coerce
from ridgeline.functions import predicates as P
from ridgeline.operators import cost, knn
from ridgeline.sources import caches, catalog, files


def write(path, data):
    path.write_bytes(data)
    return str(path)


def vecs(rows, code="f"):
    return b"".join(struct.pack(f"<i{len(r)}{code}", len(r), *r) for r in rows)


def test_vector_files(spark, tmp_path):
    path = write(tmp_path / "a.fvecs", vecs([[1, 2], [3, 4], [5, 6]]))
    assert [(r["id"], r["v"]) for r in files.read_fvecs(spark, path).orderBy("id").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 6])]
    assert files.read_fvecs(spark, path, 2).count() == 2
    assert files.read_ivecs(spark, write(tmp_path / "a.ivecs", vecs([[7, 8]], "i"))).first()["v"] == [7, 8]
    for name, data in (("bad", struct.pack("<i", 0)), ("size", vecs([[1, 2]]) + b"x"), ("none", b"")):
        with pytest.raises(files.FormatError):
            files.read_fvecs(spark, write(tmp_path / name, data))
    with pytest.raises(Exception, match="another dimension"):
        files.read_fvecs(spark, write(tmp_path / "mixed", vecs([[1, 2]]) + struct.pack("<i2f", 3, 1, 2))).collect()


def test_jsonl(spark, tmp_path):
    lines = ['{"n": 5, "c": "x"}', '{"n": "5", "c": true}', '{"n": true, "c": 2.9}', '{"n": null, "c": null}', '{"c": ["y", 1]}', '{"n": [1], "c": []}', '{"n": 1.5, "c": {"a": 1}}', "{}", '{"c": [[7]]}']
    path = write(tmp_path / "a.jsonl", "\n".join(lines).encode())
    rows = files.load_jsonl_columns(spark, path, [("n", "numeric"), ("c", "categorical")]).orderBy("id").collect()
    assert [r["n"] for r in rows] == [5, 0, 1, 0, 0, 0, 1.5, 0, 0]
    assert [r["c"] for r in rows] == ["x", "true", "2", "<null>", "y", "<other>", "<other>", "<null>", "7"]
    names = sorted({r["c"] for r in rows})
    assert all(names[int(r["c_code"])] == r["c"] for r in rows)
    assert files.load_jsonl_columns(spark, path, [("n", "numeric")], 3).count() == 3


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", b"n,c,last\r\n1.5x,a,1\r\n,,2\n\nnan,b\nabc,\"q,3\n-2e3,b,4\n")
    assert files.auto_columns(spark, path) == [("n", "numeric"), ("c", "numeric"), ("last", "numeric")]
    rows = files.load_csv_columns(spark, path, [("n", "numeric"), ("c", "categorical"), ("last", "categorical"), ("gone", "categorical")]).orderBy("id").collect()
    assert [r["n"] for r in rows[:3]] == [1.5, 0, 0] and math.isnan(rows[3]["n"]) and [r["n"] for r in rows[4:]] == [0, -2000]
    assert [r["c"] for r in rows] == ["a", "<null>", "<null>", "b", '"q', "b"]
    assert rows[0]["last"] == "1\r" and rows[3]["last"] == "<null>" and rows[0]["gone"] == "<null>"


def test_pool_and_codes(spark, tmp_path):
    texts = ["ab", "", "é"]
    raw = [t.encode() for t in texts]
    offsets = [0, 2, 2, 4]
    pool = struct.pack("<Q", 3) + struct.pack("<4Q", *offsets) + b"".join(raw)
    path = write(tmp_path / "pool", pool)
    assert [r["text"] for r in files.read_text_pool(spark, path, 3).orderBy("id").collect()] == texts
    with pytest.raises(files.FormatError):
        files.read_text_pool(spark, path, 4)
    with pytest.raises(Exception, match="truncated"):
        files.read_text_pool(spark, write(tmp_path / "short", pool[:-1]), 3).collect()
    with pytest.raises(Exception, match="out of order"):
        files.read_text_pool(spark, write(tmp_path / "wrong", struct.pack("<5Q", 3, 0, 3, 2, 4) + b"abcd"), 3).collect()
    codes = write(tmp_path / "codes", struct.pack("<3H", 1, 65535, 0))
    assert [r["code"] for r in files.read_codes(spark, codes, 3).orderBy("id").collect()] == [1, 65535, 0]


def test_pools_and_codes_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE_ROWS", 7)
    monkeypatch.setattr(files, "RANGE_BYTES", 16)
    texts = ["x" * (i * 7 % 23) + "é" * (i % 3) for i in range(60)] + ["long " * 30]
    offsets = [0]
    for t in texts:
        offsets.append(offsets[-1] + len(t.encode()))
    path = write(tmp_path / "pool", struct.pack(f"<{len(offsets) + 1}Q", len(texts), *offsets) + "".join(texts).encode())
    assert [(r["id"], r["text"]) for r in files.read_text_pool(spark, path, len(texts)).orderBy("id").collect()] == list(enumerate(texts))
    assert files.read_text_pool(spark, path, 9).count() == 9 and files.read_text_pool(spark, path, 0).count() == 0
    codes = write(tmp_path / "codes", struct.pack("<100H", *range(100)))
    assert [r["code"] for r in files.read_codes(spark, codes).orderBy("id").collect()] == list(range(100))


def test_places_in_files_of_many_partitions(spark, tmp_path):
    rows = [[i, -i] for i in range(5000)]
    path = write(tmp_path / "a.fvecs", vecs(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = write(tmp_path / "a.jsonl", "\n".join(f'{{"n": {i}, "a.b": 1, "a": {{"b": 2}}}}' for i in range(5000)).encode())
        got = files.load_jsonl_columns(spark, lines, [("n", "numeric"), ("a.b", "numeric")])
        assert got.rdd.getNumPartitions() > 4
        assert [(r[0], r[1], r[2]) for r in got.orderBy("id").collect()] == [(i, i, 1) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["id"], r["v"]) for r in files.read_fvecs(spark, path).orderBy("id").collect()] == list(enumerate(rows))


def test_deep_arrays(spark, tmp_path):
    lines = ['{"c": ' + "[" * 12 + "7" + "]" * 12 + "}", '{"c": ' + "[" * 9 + "]" * 9 + "}", '{"c": [[null]]}', '{"c": [[{"a": 1}]]}', '{"c": "[[x"}', '{"c": [["[["]]}']
    rows = files.load_jsonl_columns(spark, write(tmp_path / "a.jsonl", "\n".join(lines).encode()), [("c", "categorical")]).orderBy("id").collect()
    assert [r["c"] for r in rows] == ["7", "<other>", "<null>", "<other>", "[[x", "[["]


def test_catalogue(spark, tmp_path):
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/datasets.toml").write_text('[[dataset]]\nid = "toy"\nbase = "b"\nquery = "q"\nattributes = "a.csv"\n[[dataset.columns]]\nfield = "p"\n[[dataset.columns]]\nfield = "k"\ntype = "categorical"\n')
    write(tmp_path / "b", vecs([[1, 2], [3, 4]]))
    write(tmp_path / "q", vecs([[1, 1]]))
    write(tmp_path / "a.csv", b"p,k\n1,x\n2,y\n")
    codes = write(tmp_path / "codes", struct.pack("<2H", 4, 5))
    assert catalog.root(str(tmp_path / "configs")) == str(tmp_path)
    entry = catalog.entries((tmp_path / "configs/datasets.toml").read_text())["toy"]
    data = catalog.load(spark, entry, str(tmp_path), code_file=(codes, "kw"))
    assert [(r["id"], r["p"], r["k"], r["k_code"], r["kw"]) for r in data.base.orderBy("id").collect()] == [(0, 1, "x", 0, 4), (1, 2, "y", 1, 5)]
    assert data.categorical == ("k_code", "kw") and catalog.load(spark, entry, str(tmp_path), max_base=1).base.count() == 1
    write(tmp_path / "q", vecs([[1, 1, 1]]))
    with pytest.raises(files.FormatError):
        catalog.load(spark, entry, str(tmp_path))


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for parts in (("a", 1), ("a", 1), ("a", 2)):
        assert caches.cached(spark, str(tmp_path), "t", parts, make).count() == 3
    assert len(made) == 2
    base = spark.createDataFrame([(i, [float(i % 7), float(i)], float(i % 2)) for i in range(60)], "id bigint, v array<double>, label double")
    q = base.filter("id < 3").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    calls = []

    def once(value):
        calls.append(1)
        return value

    at = str(tmp_path / "kept")
    for _ in range(2):
        costs = caches.cached_costs(spark, at, base.select("id", F.col("label").alias("region")), lambda: once(cost.Costs(c_pred=3.0)))
        truth = caches.cached_topk(spark, at, base, q, 4, P.dnf(()), lambda: once(knn.exact_topk(base, q, 4)))
        ranks = caches.cached_ranks(spark, at, base, q, "label", 2, 16)
        parts = caches.judging_partition(spark, at, base, 4)
    assert costs.c_pred == 3.0 and truth.count() == 12 and ranks.count() == 6 and parts.count() == 60 and len(calls) == 2
    wrong = caches.key(4, 3, P.dnf(()).canonical(), coerce.fingerprint(base, "id", "v"), coerce.fingerprint(q, "qid", "qvec"))
    spark.createDataFrame([(99, 9, 1, 0.0)], "qid bigint, rank int, id bigint, dist double").write.mode("overwrite").parquet(f"{at}/topk-{wrong}")
    with pytest.raises(ValueError, match="other queries"):
        caches.cached_topk(spark, at, base, q, 4, P.dnf(()), lambda: truth)
    caches.save_tables({"x": spark.range(2)}, str(tmp_path / "index"))
    assert caches.load_tables(spark, str(tmp_path / "index"), ["x"])["x"].count() == 2
