"""Line numbers of files cut into many splits."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragscale.sources import lines

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("sample_id", T.StringType())])


def write(folder, name, n, seed):
    """Lines of very different lengths, blank ones and broken ones among them."""
    out = []
    for i in range(1, n + 1):
        kind = (i * 7 + seed) % 11
        if kind == 0:
            out.append("")
        elif kind == 1:
            out.append("   ")
        elif kind == 2:
            out.append('{"k": %d' % i)
        else:
            out.append('{"k": %d, "sample_id": %s, "pad": "%s"}' % (i, "null" if kind < 6 else '"s%d"' % i, "x" * ((i * 37) % 400)))
    (folder / name).write_text("\n".join(out) + ("\n" if seed % 2 else ""), encoding="utf-8")
    return out


@pytest.mark.parametrize("split_bytes", ["700", "20000", "128m"])
def test_every_record_and_reject_has_its_line(spark, tmp_path, split_bytes):
    written = {f"f{j}.jsonl": write(tmp_path, f"f{j}.jsonl", n, j) for j, n in enumerate((400, 1, 37, 900))}
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "other.json").write_text('{"k": 1}\n')
    before, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        numbered = lines.numbered_lines(spark, str(tmp_path)).collect()
        if split_bytes == "700":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 100
        good, bad = lines.split_numbered(lines.scan_numbered(spark, str(tmp_path), SCHEMA))
        good, bad = good.withColumn("name", lines.file_part(1)).collect(), bad.withColumn("name", lines.file_part(1)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert {(r._file.split("/")[-1], r._line): r.value for r in numbered} == {(f, i + 1): v for f, rows in written.items() for i, v in enumerate(rows)}
    assert all(r.k == r._line for r in good)
    assert sorted((r.name, r._line, r._corrupt_record) for r in bad) == sorted((f, i + 1, v) for f, rows in written.items() for i, v in enumerate(rows) if v.strip() and not v.endswith("}"))
    assert len(good) + len(bad) == sum(bool(v.strip()) for rows in written.values() for v in rows)


def test_fallback_ids_name_the_line(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"k": 1, "sample_id": "a"}\n\n{"k": 3}\n{"k": 4, "sample_id": " "}\n')
    rows = lines.scan_numbered(spark, str(tmp_path), SCHEMA).withColumns({"dataset": F.lit("nq"), "subset": F.lit("test")})
    assert {r.k: r.sample_id for r in lines.line_ids(rows).collect()} == {1: "a", 3: "nq_test_3", 4: "nq_test_4"}
    (tmp_path / "none").mkdir()
    assert lines.numbered_lines(spark, str(tmp_path / "none")).count() == 0
