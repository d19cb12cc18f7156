"""Collections that grow: ids of stored chunks stay, only new files are read."""

import json
import os

from pyspark.sql import types as T

from ragscale.sources.growing import grow, grown, last_build

SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("metadata", T.StructType([
    T.StructField("original_passages", T.ArrayType(T.StringType())), T.StructField("knowledge", T.StringType())]))])


def line(i, text, id=True):
    return json.dumps({"sample_id": f"s{i:03}" if id else None, "metadata": {"original_passages": [text, ""], "knowledge": f"known {i}" if i % 3 == 0 else ""}})


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def put(root, dataset, subset, rows):
    folder = root / dataset / "normalized"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{subset}.jsonl").write_text("\n".join(rows) + "\n")


def read(spark, path):
    return {(r.dataset, r.subset, r.chunk_id): r.text for r in grown(spark, path).collect()}


def numbers(chunks):
    out = {}
    for d, s, i in chunks:
        out.setdefault((d, s), []).append(int(i.rsplit("_chunk_", 1)[1]))
    return {k: sorted(v) for k, v in out.items()}


def test_two_appends_keep_what_a_full_build_gave(spark, tmp_path):
    root, path = tmp_path / "data", str(tmp_path / "out")
    first = [line(i, words(i, 5 + 7 * i)) for i in range(9)] + ["{broken", "", line(50, words(50, 3), id=False)]
    put(root, "nq", "train", first)
    put(root, "rgb", "noise", [line(i, words(i, 12)) for i in range(4)])
    go = lambda: grow(spark, str(root), path, SCHEMA, size=20, overlap=5)
    assert go() == 2
    full = read(spark, path)
    assert "nq_train_12_chunk_" in " ".join(i for _, _, i in full) and len(full) > 25
    assert [(r._line, r._corrupt_record) for r in spark.read.parquet(f"{path}/rejects").collect()] == [(10, "{broken")]
    assert go() == 0 and last_build(spark, path) == 0

    put(root, "nq", "dev", [line(i, words(i, 9)) for i in range(3)])  # a new file
    old = root / "rgb" / "normalized" / "noise.jsonl"
    stat = old.stat()
    old.write_text("x" * (stat.st_size - 1) + "\n")  # would be seen if it were read again
    os.utime(old, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert go() == 1
    second = read(spark, path)
    assert {k: second[k] for k in full} == full and {k[:2] for k in second.keys() - full.keys()} == {("nq", "dev")}

    put(root, "nq", "train", [line(70, words(70, 30)), *first, line(71, words(71, 50)), line(3, words(3, 26))])  # lines move, some are new, one is there twice
    assert go() == 1 and last_build(spark, path) == 2
    third = read(spark, path)
    assert {k: third[k] for k in second} == second
    added = {i.split("_chunk_")[0] for _, _, i in third.keys() - second.keys()}
    assert {"s070", "s071"} <= added <= {"s070", "s071", "nq_train_13"}  # a line without an id is named by its new line
    assert all(v == list(range(len(v))) for v in numbers(third).values())


def test_a_build_that_failed_does_not_count(spark, tmp_path):
    root, path = tmp_path / "data", str(tmp_path / "out")
    put(root, "nq", "train", [line(i, words(i, 30)) for i in range(4)])
    grow(spark, str(root), path, SCHEMA, size=20, overlap=5)
    want = read(spark, path)
    put(root, "nq", "dev", [line(i, words(i, 30)) for i in range(2)])
    spark.createDataFrame([("nq", "train", "lost")], "dataset string, subset string, chunk_id string").write.parquet(f"{path}/chunks/build=1")
    assert read(spark, path) == want
    assert grow(spark, str(root), path, SCHEMA, size=20, overlap=5) == 1
    assert {k[:2] for k in read(spark, path).keys() - want.keys()} == {("nq", "dev")}
