"""Typed readers and writers for the data sets: JSON with fixed schemas, binary files, CSV reports, codebooks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "id string, texto string, embedding array<float>"
DATASET = "textos array<struct<id: string, texto: string, embedding: array<float>>>, imagens array<struct<id: string, descricao: string, patches: array<array<float>>>>"
WEIGHTED = "chat array<struct<id: string, texto: string, embedding: array<float>>>, visao array<struct<id: string, descricao: string, blocos: array<struct<indice: int, peso: float, embedding: array<float>>>>>"
MODEL = "metadados struct<algoritmo: string, dimensao_entrada: int, dimensao_saida: int>, centroide array<double>, heads map<string, array<array<double>>>"
VOCABULARY = "map<string, struct<indice: int, idf: double>>"
QUESTIONS = "data array<struct<paragraphs: array<struct<context: string, qas: array<struct<question: string, answers: array<struct<text: string>>>>>>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON value a file, with a schema that is never guessed; a malformed file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def texts(dataset: DataFrame, column: str = "textos") -> DataFrame:
    return dataset.select(F.inline(column))


def patches(dataset: DataFrame) -> DataFrame:
    """(id, descricao, patch, weight, embedding) of either layout; unweighted patches weigh 1."""
    if "imagens" in dataset.columns:
        images = dataset.select(F.inline("imagens"))
        return images.select("id", "descricao", F.posexplode("patches").alias("patch", "embedding")).select("id", "descricao", "patch", F.lit(1.0).cast("float").alias("weight"), "embedding")
    images = dataset.select(F.inline("visao"))
    return images.select("id", "descricao", F.inline("blocos")).select("id", "descricao", F.col("indice").alias("patch"), F.col("peso").alias("weight"), "embedding")


def components(model: DataFrame) -> DataFrame:
    """(head, bit, dim, weight) of a stored matrix."""
    heads = model.select(F.explode("heads").alias("head", "rows"))
    return heads.select("head", F.posexplode("rows").alias("bit", "row")).select("head", "bit", F.posexplode("row").alias("dim", "weight")).withColumn("weight", F.col("weight").cast("float"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, place, idf, n_bytes, unigram) of a JSON map."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", VOCABULARY)).alias("token", "v"))
    return raw.select("token", F.col("v.indice").alias("place"), F.col("v.idf").alias("idf"), F.octet_length("token").alias("n_bytes"), (~F.contains("token", F.lit("_"))).alias("unigram"))


def questions(spark: SparkSession, path: str, context: int = 200) -> DataFrame:
    """(intent, answer, context) of a nested question set: the first answer, those without one left out."""
    p = read_json(spark, path, QUESTIONS).select(F.inline("data")).select(F.inline("paragraphs"))
    q = p.select("context", F.inline("qas")).withColumn("answer", F.get("answers.text", F.lit(0)))
    return q.filter("answer <> ''").select(F.col("question").alias("intent"), "answer", F.substring("context", 1, context).alias("context"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def user_lines(lines: DataFrame) -> DataFrame:
    """Lines that ask something: no commands, nothing blank. Works on streams and tables."""
    return lines.filter(~F.col("value").startswith("/") & (F.trim("value") != ""))


def unsigned(column: Column) -> Column:
    """An unsigned 64-bit decimal (read as DECIMAL(20,0)) as a BIGINT with the same bits."""
    wide = column.cast("decimal(20,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(21,0)")).otherwise(wide).cast("long")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def centre(model: DataFrame) -> list[float] | None:
    """The centroid of a stored matrix, if it has one: as many numbers as a vector has."""
    found = model.select("centroide").first()
    return found["centroide"] if found else None


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows below a path, or no rows where there is nothing: what depends on them is then switched off."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Vocabulary, matrices, thresholds or data sets as JSON rows; what was there is replaced."""
    rows.write.mode("overwrite").json(path)


#: The columns of a test report.
GAUNTLET = ["ID", "Tipo", "Descricao", "Distancia_Hamming", "Confianca", "Status", "Latencia_ns"]


def write_gauntlet(rows: DataFrame, path: str) -> None:
    """rows (id, kind, description, distance, confidence, status, ns) as a report."""
    write_report(rows.toDF(*GAUNTLET), path)


#: The first bytes of a codebook file, its version, and where its patterns begin at least.
CODEBOOK, VERSION, START = b"CBK1", 1, 512


def codebook_bytes(patterns: list[bytes]) -> bytes:
    """A codebook file: head (magic, version, size of a pattern, their number, where they begin), then patterns of one size."""
    size = len(patterns[0]) if patterns else 1
    head = CODEBOOK + b"".join(x.to_bytes(4, "little") for x in (VERSION, size, len(patterns), START))
    return head.ljust(START, b"\0") + b"".join(patterns)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, data) of codebook files; a wrong head or a file that is cut off is an error. One row of a file's bytes is a codebook: of bounded size."""
    raw = files(spark, path) if not path.endswith(".bin") else spark.read.format("binaryFile").load(path).select("path", "length", "content")
    number = lambda at: F.conv(F.concat(*(F.hex(F.substring("content", at + k, 1)) for k in (3, 2, 1, 0))), 16, 10).cast("long")
    head = raw.select("path", "length", "content", (F.substring("content", 1, 4) == F.lit(CODEBOOK)).alias("known"), number(5).alias("version"), number(9).alias("size"), number(13).alias("n"), number(17).alias("start"))
    fits = F.col("known") & (F.col("version") == VERSION) & (F.col("size") > 0) & (F.col("start") >= START) & (F.col("length") >= F.col("start") + F.col("size") * F.col("n"))
    checked = head.withColumn("content", F.when(fits, F.col("content")).otherwise(F.raise_error(F.lit("not a codebook, or it is cut off")).cast("binary")))
    # patterns are sliced inside the row: no row carries the whole file for each of its patterns
    at = lambda i: F.substr("content", (F.col("start") + i * F.col("size") + 1).cast("int"), F.col("size").cast("int"))
    patterns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.struct(i.alias("id"), at(i).alias("data")))
    return checked.filter("n > 0").select("path", F.inline(patterns))
