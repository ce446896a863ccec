"""CSV with line breaks in cells, read in splits, columns by header."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import hygiene
from ledgerproof.sources import files


def write(path, columns, rows, bom=False, end="\n"):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(columns)
    w.writerows(rows)
    path.write_bytes((("\ufeff" if bom else "") + out.getvalue()).encode())


def cell(rng):
    return "".join(rng.choice(["a", "b\n", '"', ",", '{"k":1}', " ", "\n\n", "é"]) for _ in range(rng.randrange(1, 9)))


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 16])
def test_records_over_splits(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    want = []
    for k in range(3):
        columns = [["id", "x", "y"], ["y", "id", "x"], ["x", "id"]][k]
        rows = [{"id": f"{k}-{i}", "x": cell(rng), "y": cell(rng)} for i in range(200)]
        write(tmp_path / f"f{k}.csv", columns, [[r[c] for c in columns] for r in rows], bom=k == 1, end="\r\n" if k == 1 else "\n")
        want += [(r["id"], r["x"], r["y"] if "y" in columns else None) for r in rows]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    build = files.csv_records
    try:
        files.csv_records = lambda s, p: build(s, p, chunk)
        read = files.read_text_cells(spark, str(tmp_path), ["id", "x", "y"])
        got = sorted(tuple(r) for r in read.collect())
        assert spark.read.text(f"{tmp_path}/f0.csv").rdd.getNumPartitions() > 5
    finally:
        files.csv_records = build
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(want)


def test_known_ends_of_other_depth_stay(spark):
    ends = {"/python.exe": "env/python.exe", "/bin/python.exe": "bin/python.exe", "x": "one"} | {f"/place{i}": f"p{i}" for i in range(40)}
    texts = ["C:\\u\\python.exe", "C:\\u\\bin\\python.exe", "C:\\python.exe\\more", "C:/a/place7", "C:/a/place7/b", "python.exe", None, "C:/x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hygiene.redact(F.col("t"), "/root", ["C:"], [], ends)).collect()]
    assert got == ["env/python.exe", "bin/python.exe", hygiene.REDACTED, "p7", hygiene.REDACTED, "python.exe", None, "one"]
