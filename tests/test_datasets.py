import json
import pathlib

import pytest
from pyspark.sql import functions as F

from hashloom.sources import datasets, tables
from hashloom.streaming import runs, state


def rows_of(spark, tmp_path, n):
    """n records in a file, as the sinks want them."""
    path = str(tmp_path / f"rows{n}")
    spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("é\"\n"), F.col("id").cast("string"))).alias("texto"), F.array(F.col("id").cast("float") / 7).cast("array<float>").alias("embedding")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("n", [0, 1, 25])
def test_records_in_bounded_files(spark, tmp_path, n):
    """Nulls, quotes, line ends and no rows at all come back as they were; no file has more rows than stated."""
    rows, path = rows_of(spark, tmp_path, n), str(tmp_path / "out")
    datasets.write_records(rows, path, per_file=10)
    back = tables.read_json(spark, path, tables.RECORD).select(*rows.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    sizes = [len(json.loads(p.read_text())) for p in pathlib.Path(path).rglob("part-*.txt")]
    assert sum(sizes) == n and all(0 < s <= 10 for s in sizes)


def test_dataset_with_an_empty_table(spark, tmp_path):
    rows, path = rows_of(spark, tmp_path, 5), str(tmp_path / "out")
    images = rows.select("id", F.col("texto").alias("descricao"), F.array("embedding", "embedding").alias("patches"))
    datasets.write_dataset(path, per_file=2, textos=rows, imagens=images.limit(0))
    read = tables.read_json(spark, path, tables.DATASET)
    assert tables.texts(read).count() == 5 and tables.patches(read).count() == 0
    datasets.write_dataset(path, per_file=2, textos=rows.limit(0), imagens=images)
    read = tables.read_json(spark, path, tables.DATASET)
    assert tables.texts(read).count() == 0 and tables.patches(read).count() == 10


def test_matrix_rows_of_another_width(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0])], "head string, row array<double>")
    with pytest.raises(Exception, match="another width"):
        datasets.write_matrices(rows, str(tmp_path / "m"), 2)


def test_codebooks_by_name(spark, tmp_path):
    """Two books in one folder, ids in order whatever the order of rows; gaps and mixed sizes are errors; files no manifest names are not read."""
    path, kept = str(tmp_path / "books"), str(tmp_path / "manifest")
    rows = spark.createDataFrame([("b", 1, b"zz"), ("b", 0, b"yy"), ("c", 0, b"\0\1\2")], "book string, id long, data binary")
    datasets.write_codebooks(rows, path).write.parquet(kept)
    datasets.write_codebooks(rows, path).count()  # tasks that run again
    manifest = spark.read.parquet(kept)
    got = datasets.read_codebooks(spark, path, manifest).collect()
    assert sorted((r.book, r.id, bytes(r.data)) for r in got) == [("b", 0, b"yy"), ("b", 1, b"zz"), ("c", 0, b"\0\1\2")]
    for bad in ([("b", 1, b"zz")], [("b", 0, b"zz"), ("b", 1, b"z")]):
        with pytest.raises(Exception, match="ids from 0 on and one size"):
            datasets.write_codebooks(spark.createDataFrame(bad, rows.schema), path).count()


def test_runs_go_on_from_the_checkpoint(spark, tmp_path):
    """A second run reads what is new alone, with the state of the first; a run with nothing new writes nothing."""
    some = [spark.createDataFrame(x, "bucket string, failed boolean") for x in ([("a", True)] * 3, [("a", True), ("b", False)])]
    out = runs.in_runs(spark, some, str(tmp_path), state.thresholds, updates=True)
    last = {r.bucket: r.m for r in out.groupBy("bucket").agg(F.max_by("middle", "batch").alias("m")).collect()}
    assert last["a"] == pytest.approx(4 * 0.85**4) and last["b"] == 4.0
    before = out.count()
    assert runs.in_runs(spark, [some[0].limit(0)], str(tmp_path), state.thresholds, updates=True).count() == before


def test_stream_against_too_large_a_table(spark):
    kb = spark.range(20).select("id", F.col("id").alias("hash"), F.lit("x").alias("answer"))
    with pytest.raises(ValueError, match="more than 16"):
        state.answered(spark.range(1).select(F.col("id").alias("query"), F.col("id").alias("qhash")), kb, 2, capacity=16)
