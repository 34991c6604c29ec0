"""Queries over tables larger than those given: keys beyond them, and what a worker holds."""

import gc
import hashlib
import tracemalloc

import __spark_entry__
from diskloom.build.disk import mbr_disk, mbr_parts
from diskloom.build.ext4 import build_ext4
from diskloom.build.fat import build_fat
from diskloom.build.tree import File
from diskloom.container.writer import write
from diskloom.operators import files as ops
from diskloom.plans.queries import BUILDERS, VARIANTS


def test_sizes_of_large_keys(spark, tmp_path):
    keys = [0, 1, 101, 14_999, 208_272, 899_999, 10**7]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: r["size"] for r in __spark_entry__.queries()["human_sizes"](spark, str(tmp_path)).collect()}
    units = [(1 << 40, "TB"), (1 << 30, "GB"), (1 << 20, "MB")]
    want = {k: next((f"{k**3 * 1021 / u:.2f} {name}" for u, name in units if k**3 * 1021 >= u), f"{k**3 * 1021} bytes") for k in keys}
    assert got == want


def test_volumes_are_not_held_after_they_are_built():
    """Without the collector of cycles: a worker builds many volumes, and each must go at once."""
    files = [File(f"de/src{k % 5}/doc_{k}.txt", bytes([k % 256]) * 9000) for k in range(120)]
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for kind, (build, _) in BUILDERS.items():
            build(files[:40])
            before = tracemalloc.get_traced_memory()[0]
            build(files)
            assert tracemalloc.get_traced_memory()[0] - before < 200_000, kind
    finally:
        tracemalloc.stop()
        gc.enable()


def test_a_sparse_volume_is_written_without_a_copy(tmp_path):
    build, code = BUILDERS["fat32"]
    files = [File(f"d/f{k}", bytes([k]) * 5000) for k in range(50)]
    whole = b"".join(build(files))
    assert whole == build_fat(files, 32, scatter=True) and len(whole) > 33_000_000
    write(f"{tmp_path}/a.E01", mbr_disk([(code, whole)]))
    tracemalloc.start()
    try:
        write(f"{tmp_path}/b.E01", mbr_parts([(code, build(files))]))
        assert tracemalloc.get_traced_memory()[1] < 12_000_000
    finally:
        tracemalloc.stop()
    assert open(f"{tmp_path}/a.E01", "rb").read() == open(f"{tmp_path}/b.E01", "rb").read()


def test_lzvn_holds_few_texts(spark, tmp_path):
    texts = ["", "a" * 3000, "Zoë " * 500, None, *(f"text {k} " * k for k in range(100))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = __spark_entry__.queries()["lzvn"](spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    want = {(k, len(t.encode()), hashlib.md5(t.encode()).hexdigest()) for k, t in enumerate(texts) if t is not None}
    assert {tuple(r) for r in found.collect()} == want and len(want) == 103


def test_container_matrix_deals_texts_out_once(spark, tmp_path, monkeypatch):
    texts = ["", None, "Zoë " * 300, *(f"text {k} " * (40 * k) for k in range(60))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kind = type(spark.range(1).groupBy("id"))
    dealt, apply = [], kind.applyInPandas
    monkeypatch.setattr(kind, "applyInPandas", lambda self, *a: dealt.append(a) or apply(self, *a))
    got = {tuple(r) for r in __spark_entry__.queries()["container_matrix"](spark, str(tmp_path)).collect()}
    there = [t.encode() for t in texts if t is not None]
    mark = sum(int(hashlib.md5(t).hexdigest()[:8], 16) for t in there)
    assert got == {(name, len(there), sum(map(len, there)), mark) for name, _ in VARIANTS} and len(got) == 10
    assert len(dealt) == 1


def test_container_matrix_of_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert __spark_entry__.queries()["container_matrix"](spark, str(tmp_path)).collect() == []


def test_sparse_files_are_hashed_once(spark, tmp_path):
    keys = [0, 1, 4094, 4095, 4096, 14_999, 899_999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = __spark_entry__.queries()["sparse_files"](spark, str(tmp_path))
    assert "sha1" not in found._jdf.queryExecution().executedPlan().toString()
    data = {k: bytes(8192) + (b"x" * (1 + k % 4096)).ljust(65536 - 8192, b"\0") + b"tail" for k in keys}
    assert {tuple(r) for r in found.collect()} == {(f"/sparse/f{k}.bin", hashlib.md5(d).hexdigest()) for k, d in data.items()}


def test_hashes_of_both_kinds(spark, tmp_path):
    files = [File("a", b"x" * 5000), File("h", parts=[(8192, b"y")], size=70_000)]
    write(f"{tmp_path}/a.E01", mbr_disk([(0x83, build_ext4(files))]))
    got = {r["path"]: (r["md5"], r["sha1"]) for r in ops.hashes(ops.files(ops.nodes(spark, str(tmp_path)), with_extents=True)).collect()}
    want = {"/a": b"x" * 5000, "/h": bytes(8192) + b"y" + bytes(70_000 - 8193)}
    assert got == {p: (hashlib.md5(d).hexdigest(), hashlib.sha1(d).hexdigest()) for p, d in want.items()}
