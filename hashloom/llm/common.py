"""What the operators of this subpackage share: shared folders, written intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes at most that a task takes of an Arrow batch at once (a single row may have more): very long texts still fit a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Bits of a filter for each member, and 64-bit words of a filter at most (8 MiB, so that it can be broadcast): with more members it lets more rows pass.
FILTER_BITS, FILTER_WORDS = 16, 1 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir (set here only where it is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="hashloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/hashloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that the operators have written for this application: call it when all results have been read."""
    path = shared_dir(spark, "x")
    _delete(spark, path[: path.rindex("/")])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs nothing already written."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize() that no result will read again."""
    for df in written:
        if path := getattr(df, "_written_to", None):
            _delete(df.sparkSession, path)


class KeyFilter:
    """A written filter of keys: two bits of one 64-bit word for each member.

    It grows with the number of members, up to FILTER_WORDS words, and is broadcast; a fuller filter only lets more rows
    pass. members: a written table, small rows.
    """

    def __init__(self, members: DataFrame, keys: list[str]):
        self.keys, self.n, self.words = keys, members.count(), 64
        while self.words < FILTER_WORDS and self.words * 64 < self.n * FILTER_BITS:
            self.words *= 2
        if self.n:
            word, mask = self._place()
            self.table = materialize(members.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits")), "filter")

    def _place(self):
        h, one = F.xxhash64(*self.keys), F.lit(1).cast("long")
        bit = lambda at: F.call_function("shiftleft", one, at.bitwiseAND(F.lit(63)).cast("int"))
        return F.shiftrightunsigned(h, 12).bitwiseAND(F.lit(self.words - 1)), bit(h).bitwiseOR(bit(F.shiftrightunsigned(h, 6)))

    def split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows in two parts: those whose keys may be a member's, and those whose keys surely are not."""
        if not self.n:
            return rows.limit(0), rows
        word, mask = self._place()
        at, bits = unused("_word", rows.columns), unused("_bits", rows.columns)
        met = rows.withColumn(at, word).join(F.broadcast(self.table.toDF(at, bits)), at, "left")
        hit = F.coalesce(F.col(bits).bitwiseAND(mask) == mask, F.lit(False))
        return tuple(met.filter(x).select(*(F.col(f"`{c}`") for c in rows.columns)) for x in (hit, ~hit))


def sifted(rows: DataFrame, keys: list[str], members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose keys may be those of a row of members, and those whose keys surely are not."""
    return KeyFilter(members, keys).split(rows)


def without(rows: DataFrame, keys: list[str], lost: DataFrame) -> DataFrame:
    """rows whose keys are not in lost (a written table); only rows that pass lost's filter are shuffled. Null keys are not looked for."""
    maybe, others = sifted(rows, keys, lost)
    return others.unionByName(maybe.join(lost.select(*keys).hint("merge"), keys, "left_anti"))


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a written number of each row, which names it whatever its doc_id (null and repeated ones do not), and that column's name."""
    key = unused("_row", docs.columns)
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; every other column is left behind, whatever its name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def in_parts(batches):
    """Slices of BATCH_ROWS rows and BATCH_BYTES bytes at most; they share the batch's memory."""
    for b in batches:
        held = [b]
        while held:
            b = held.pop()
            if b.num_rows > 1 and (b.num_rows > BATCH_ROWS or b.nbytes > BATCH_BYTES):
                half = b.num_rows // 2
                held += [b.slice(half), b.slice(0, half)]
            else:
                yield b


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow over slices bounded in rows and bytes; the session's own settings stay as they are."""
    return df.mapInArrow(lambda batches: fn(in_parts(batches)), schema)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def open_fs(path: str):
    """(filesystem, path in it) of a folder named by a URI or a plain path, for use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
