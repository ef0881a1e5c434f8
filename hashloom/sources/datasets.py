"""Sinks for data sets whose files hold one JSON value or one codebook each, with files of bounded size."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import open_fs
from .tables import codebook_bytes, read_codebook

#: Rows that one file holds at most.
PER_FILE = 10_000


def parts(rows: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(part, rows): at most per_file rows of rows in an array. Rows are numbered where they lie, so no key can make a part larger.

    rows: read from files, so that a task which runs again numbers them alike. No rows: no parts.
    """
    at = F.expr(f"monotonically_increasing_id() DIV {per_file}")
    return rows.select(F.struct(*rows.columns).alias("row"), at.alias("part")).groupBy("part").agg(F.collect_list("row").alias("rows"))


def _one_value_a_file(values: DataFrame, path: str) -> None:
    """values (part, value) -> a file for each part; what was there is replaced."""
    values.select("part", F.to_json("value").alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def write_records(rows: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """rows as files of one JSON array each."""
    _one_value_a_file(parts(rows, per_file).select("part", F.col("rows").alias("value")), path)


def write_dataset(path: str, per_file: int = PER_FILE, **tables: DataFrame) -> None:
    """Named tables as files of one JSON object each, whose fields are arrays of rows: a file has rows of one table, and empty arrays for the others."""

    def values(place: int, name: str) -> DataFrame:
        fields = [(F.col("rows") if x == name else F.array()).alias(x) for x in tables]
        return parts(tables[name], per_file).select((F.col("part") * len(tables) + place).alias("part"), F.to_json(F.struct(*fields)).alias("value"))

    written = [values(i, name) for i, name in enumerate(tables)]
    all_of = written[0]
    for more in written[1:]:
        all_of = all_of.unionByName(more)
    all_of.write.mode("overwrite").partitionBy("part").text(path)


def write_matrices(rows: DataFrame, path: str, width: int, per_file: int = PER_FILE) -> None:
    """(head, row) as files of named matrices: each head's rows of a file, in no order of their own. A row that is not `width` wide is an error."""
    fits = F.when(F.size("row") == width, F.col("row")).otherwise(F.raise_error(F.lit("a matrix row of another width")))
    numbered = rows.select("head", fits.alias("row"), F.expr(f"monotonically_increasing_id() DIV {per_file}").alias("part"))
    heads = numbered.groupBy("part", "head").agg(F.collect_list("row").alias("m"))
    model = heads.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("head", "m"))).alias("heads"), F.sum(F.size("m")).alias("n"))
    about = F.struct(F.lit("rows").alias("algoritmo"), F.lit(width).alias("dimensao_entrada"), F.col("n").alias("dimensao_saida"))
    _one_value_a_file(model.select("part", F.struct(about.alias("metadados"), "heads").alias("value")), path)


def write_vocabulary(words: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """(token, place, idf) as files of one JSON map each; tokens are distinct."""
    entry = lambda r: F.struct(r["token"], F.struct(r["place"].cast("int").alias("indice"), r["idf"].alias("idf")))
    held = parts(words.select("token", "place", "idf"), per_file)
    _one_value_a_file(held.select("part", F.map_from_entries(F.transform("rows", entry)).alias("value")), path)


def write_questions(pairs: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """(question, answers, context) as files of a nested question set, a paragraph for each row."""

    def paragraph(r: Column) -> Column:
        answers = F.transform(r["answers"], lambda a: F.struct(a.alias("text")))
        return F.struct(r["context"].alias("context"), F.array(F.struct(r["question"].alias("question"), answers.alias("answers"))).alias("qas"))

    held = parts(pairs.select("question", "answers", "context"), per_file)
    data = F.array(F.struct(F.transform("rows", paragraph).alias("paragraphs")))
    _one_value_a_file(held.select("part", F.struct(data.alias("data")).alias("value")), path)


def write_codebooks(patterns: DataFrame, path: str) -> DataFrame:
    """(book, id, data) as one codebook file for each book, patterns in order of their ids -> book, file, patterns, sha256 of the patterns.

    Patterns of a book have one size; another size, or ids that are not 0, 1, 2 on, are an error. A book is of bounded
    size: a task holds it whole. Files take their names when whole; those of tasks that ran again are not in the result,
    which has to be kept: each action on it writes files anew.
    """

    def write(key, f: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        f = f.sort_values("id")
        words = [bytes(x) for x in f["data"]]
        if list(f["id"]) != list(range(len(words))) or len({len(w) for w in words}) != 1:
            raise ValueError("patterns of a codebook have ids from 0 on and one size")
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        name = f"{key[0]}-{uuid.uuid4().hex}.bin"
        held = f"{root}/_{name}"
        with fs.open_output_stream(held) as out:
            out.write(codebook_bytes(words))
        fs.move(held, f"{root}/{name}")
        return pd.DataFrame([(key[0], name, len(words), hashlib.sha256(b"".join(words)).hexdigest())], columns=["book", "file", "patterns", "sha256"])

    return patterns.groupBy("book").applyInPandas(write, "book string, file string, patterns long, sha256 string")


def read_codebooks(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(book, id, data) of the files that a manifest of write_codebooks() names."""
    rows = read_codebook(spark, path).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return rows.join(manifest.select("book", "file"), "file").select("book", "id", "data")
