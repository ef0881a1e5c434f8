"""Queries over data sets in files: each writes a given table in a layout, reads it with the typed reader, and tells what came back; and over streams of such files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hashloom.functions import text
from hashloom.operators import chunks, codebook
from hashloom.sources import datasets, files, tables
from hashloom.streaming import runs, state

from . import dialogue
from .sqltext import TOKENS
from .texts import COUNTS, ELITE, chunk_counts, documents, fixed_sql, table, turn_hashes

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def digest_sql(values: str, scale: int = 1_000_000) -> str:
    return f"list_sum(list_transform(range(len({values})), lambda i: (i + 1) * round({values}[i + 1]::DOUBLE * {scale})::BIGINT))::BIGINT"


def digest(values: str, scale: int = 1_000_000):
    """A whole number that tells vectors apart: millionths, each times its place."""
    terms = F.transform(values, lambda x, i: (i + 1) * F.round(x.cast("double") * scale).cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit('"'), F.col("label").cast("string"), F.lit("\\\n")).alias("texto"), "embedding")


_TEXTO = "'\"' || label || '\\' || chr(10)"


@query(f"SELECT vec_id AS id, md5({_TEXTO}) AS texto_md5, len(embedding)::BIGINT AS dims, {digest_sql('embedding')} AS digest FROM embeddings")
def json_records(spark, sf_dir):
    """Vectors as JSON arrays of records with texts that need escapes, read back."""
    path = files.scratch(spark, "records")
    datasets.write_records(vectors(spark, sf_dir), path)
    rows = tables.read_json(spark, path, tables.RECORD)
    return rows.select(F.col("id").cast("long").alias("id"), F.md5("texto").alias("texto_md5"), F.size("embedding").cast("long").alias("dims"), digest("embedding").alias("digest"))


_QUARTER = "embedding[patch * 16 + 1 : patch * 16 + 16]"


def quarters():
    """A vector's four quarters, as patches of an image."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice("embedding", p * 16 + 1, 16))


@query(f"""SELECT 'texto' AS kind, vec_id AS id, NULL::BIGINT AS patch, NULL::DOUBLE AS weight, {digest_sql('embedding')} AS digest FROM embeddings
UNION ALL SELECT 'imagem', vec_id, patch, 1.0, {digest_sql(_QUARTER)} FROM embeddings, range(4) t(patch)""")
def json_dataset(spark, sf_dir):
    """One data set of texts and of images in patches, in objects with two arrays."""
    v, path = vectors(spark, sf_dir), files.scratch(spark, "dataset")
    images = v.select("id", F.col("texto").alias("descricao"), quarters().alias("patches"))
    datasets.write_dataset(path, textos=v, imagens=images)
    return both(tables.read_json(spark, path, tables.DATASET), "textos")


def both(read, column):
    told = tables.texts(read, column).select(F.lit("texto").alias("kind"), F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("patch"), F.lit(None).cast("double").alias("weight"), digest("embedding").alias("digest"))
    seen = tables.patches(read).select(F.lit("imagem").alias("kind"), F.col("id").cast("long").alias("id"), F.col("patch").cast("long").alias("patch"), F.col("weight").cast("double").alias("weight"), digest("embedding").alias("digest"))
    return told.unionByName(seen)


@query(f"""SELECT 'texto' AS kind, vec_id AS id, NULL::BIGINT AS patch, NULL::DOUBLE AS weight, {digest_sql('embedding')} AS digest FROM embeddings
UNION ALL SELECT 'imagem', vec_id, patch, CASE WHEN patch IN (1, 2) THEN 1.5 ELSE 0.5 END, {digest_sql(_QUARTER)} FROM embeddings, range(4) t(patch)""")
def json_weighted_dataset(spark, sf_dir):
    """The layout whose images have weighted blocks: those in the middle weigh more."""
    v, path = vectors(spark, sf_dir), files.scratch(spark, "weighted")
    block = lambda p, i: F.struct(i.alias("indice"), F.when(i.isin(1, 2), 1.5).otherwise(0.5).cast("float").alias("peso"), p.alias("embedding"))
    images = v.select("id", F.col("texto").alias("descricao"), F.transform(quarters(), block).alias("blocos"))
    datasets.write_dataset(path, chat=v, visao=images)
    return both(tables.read_json(spark, path, tables.WEIGHTED), "chat")


@query("""WITH e AS (SELECT label, dim, (embedding[dim + 1]::DOUBLE / 3)::FLOAT AS weight FROM embeddings, range(64) t(dim))
SELECT label::VARCHAR AS head, dim, count(*) AS n, sum(round(weight::DOUBLE * 1000000)::BIGINT)::BIGINT AS total FROM e GROUP BY label, dim""")
def matrix_files(spark, sf_dir):
    """Named matrices of doubles, a row for each vector, read as 32-bit floats: rows and sum of each column."""
    path = files.scratch(spark, "matrices")
    thirds = F.transform("embedding", lambda x: x.cast("double") / 3)
    datasets.write_matrices(table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("head"), thirds.alias("row")), path, 64)
    w = tables.components(tables.read_json(spark, path, tables.MODEL))
    return w.groupBy("head", F.col("dim").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("weight").cast("double") * 1_000_000).cast("long")).alias("total"))


@query(f"""WITH t AS (SELECT {TOKENS} AS w FROM documents), g AS (SELECT unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])))) AS token FROM t),
df AS (SELECT token, count(*) AS df FROM g GROUP BY token ORDER BY df DESC, token LIMIT 2048)
SELECT token, row_number() OVER (ORDER BY df DESC, token) - 1 AS place, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 6) AS idf, strlen(token) AS n_bytes, NOT contains(token, '_') AS unigram FROM df""")
def vocabulary_file(spark, sf_dir):
    """The 2048 words and pairs of words that most documents have, written as a map and read with the columns of a length index."""
    docs, path = documents(spark, sf_dir), files.scratch(spark, "vocabulary")
    words = docs.select(text.tokens(F.col("text")).alias("w"))
    each = words.select(F.explode(F.array_distinct(F.concat("w", text.ngrams(F.col("w"), 2)))).alias("token"))
    top = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "token").limit(2048)
    place = F.row_number().over(Window.orderBy(F.desc("df"), "token")) - 1
    ranked = top.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n")))).select("token", place.alias("place"), (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    datasets.write_vocabulary(files.kept(ranked, "ranked"), path)
    return tables.vocabulary(spark, path).select("token", F.col("place").cast("long").alias("place"), F.round("idf", 6).alias("idf"), F.col("n_bytes").cast("long").alias("n_bytes"), "unigram")


_BUCKET = "user_id || ':' || (event_id // 1000)"
_FEEDBACK = f"""WITH n AS (SELECT {_BUCKET} AS bucket, count(*) FILTER (event_type = 'error' AND value < 10) AS first, count(*) FILTER (event_type = 'error' AND value >= 10) AS later FROM events GROUP BY ALL)
SELECT bucket, round(greatest(1, greatest(1, 4 * power(0.85, first)) * power(0.85, later)), 6) AS middle FROM n"""


def feedback(spark, sf_dir):
    """(bucket, failed, late): whether an event of a user's thousand failed, and whether it is told in the second run."""
    e = table(spark, sf_dir, "events")
    bucket = F.concat_ws(":", F.col("user_id").cast("string"), F.expr("event_id DIV 1000").cast("string"))
    return e.select(bucket.alias("bucket"), (F.col("event_type") == "error").alias("failed"), (F.col("value") >= 10).alias("late"))


@query(_FEEDBACK)
def feedback_file(spark, sf_dir):
    """Thresholds in a file that is not there at first: created, read again, and written anew after more feedback."""
    rows, path = feedback(spark, sf_dir), files.scratch(spark, "feedback")
    schema, place = "bucket string, middle double", f"{path}/0"  # nothing lies there
    for version, late in enumerate((False, True), 1):
        before = tables.read_optional(spark, place, schema)
        failures = rows.filter(F.col("late") == late).groupBy("bucket").agg(F.count_if("failed").alias("n"))
        after = before.join(failures, "bucket", "full").select("bucket", F.greatest(F.lit(1.0), F.coalesce("middle", F.lit(4.0)) * F.pow(F.lit(0.85), F.coalesce("n", F.lit(0)))).alias("middle"))
        place = f"{path}/{version}"
        tables.write_json(after, place)
    return tables.read_optional(spark, place, schema).select("bucket", F.round("middle", 6).alias("middle"))


@query(_FEEDBACK)
def feedback_stream(spark, sf_dir):
    """The same as keyed state of a stream in two runs, the second from the first one's checkpoint: each bucket's last threshold."""
    rows = feedback(spark, sf_dir)
    arrivals = [rows.filter(F.col("late") == late).select("bucket", "failed") for late in (False, True)]
    out = runs.in_runs(spark, arrivals, files.scratch(spark, "thresholds"), state.thresholds, updates=True)
    return out.groupBy("bucket").agg(F.round(F.max_by("middle", "batch"), 6).alias("middle"))


@query(dialogue.SQL["context_reset_fold"])
def cache_stream(spark, sf_dir):
    """The semantic cache with contexts (context_reset_fold) as keyed state: later turns come in after a restart."""
    rows = files.kept(turn_hashes(spark, sf_dir).select("at.conv_id", "at.turn", "hash"), "turns")
    arrivals = [rows.filter("turn < 3"), rows.filter("turn >= 3")]
    return runs.in_runs(spark, arrivals, files.scratch(spark, "cache"), state.semantic_cache)


@query("SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS line FROM conversations WHERE role = 'user') WHERE trim(line) <> '' AND NOT starts_with(line, '/') GROUP BY ALL")
def line_stream(spark, sf_dir):
    """Turns as lines of text files, other roles' as commands, read as a stream that leaves commands and blank lines out."""
    t = table(spark, sf_dir, "conversations")
    line = F.regexp_replace("text", r"[\r\n]", " ")
    written = t.select(F.when(F.col("role") == "user", line).otherwise(F.concat(F.lit("/"), line)).alias("value"))
    folder = files.scratch(spark, "lines")
    written.select(F.coalesce("value", F.lit("")).alias("value")).write.text(f"{folder}/in")
    runs.run(tables.user_lines(spark.readStream.text(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("value string").parquet(f"{folder}/out").groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query(dialogue.SQL["gauntlet_report"].replace("SELECT id, description,", "SELECT id::VARCHAR AS ID, description AS Descricao,").replace("END AS kind, distance, confidence,", "END AS Tipo, distance AS Distancia_Hamming, confidence AS Confianca,").replace("END AS status FROM", "END AS Status, 0::BIGINT AS Latencia_ns FROM"))
def report_file(spark, sf_dir):
    """The test report (gauntlet_report) as CSV with its fixed header, read back by names."""
    path = files.scratch(spark, "report")
    rows = dialogue.gauntlet_report(spark, sf_dir).select("id", "kind", "description", "distance", "confidence", "status", F.lit(0).alias("ns"))
    tables.write_gauntlet(rows, path)
    return spark.read.option("header", True).option("enforceSchema", False).schema("ID string, Tipo string, Descricao string, Distancia_Hamming bigint, Confianca double, Status string, Latencia_ns bigint").csv(path)


@query("SELECT q.conv_id, q.turn, md5(q.text) AS intent_md5, md5(a.text) AS answer_md5, md5(substr(a.text, 1, 200)) AS context_md5 FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.text <> ''")
def question_set(spark, sf_dir):
    """Questions and what followed them as a nested set, flattened to the first answers; questions without one are left out."""
    t, path = table(spark, sf_dir, "conversations"), files.scratch(spark, "questions")
    after = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = t.filter("role = 'user'").join(after, ["conv_id", "turn"], "left")
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce("text", F.lit("")))
    answers = F.when(F.col("answer").isNull(), F.array().cast("array<string>")).otherwise(F.array("answer", F.lit("another")))
    datasets.write_questions(files.kept(asked.select(name.alias("question"), answers.alias("answers"), F.coalesce("answer", F.lit("")).alias("context")), "asked"), path)
    part = F.split("intent", ":", 3)
    return tables.questions(spark, path).select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), F.md5(part[2]).alias("intent_md5"), F.md5("answer").alias("answer_md5"), F.md5("context").alias("context_md5"))


@query("SELECT doc_id, coalesce(lang, 'none') AS folder, sha256(coalesce(text, '')) AS digest FROM documents")
def folder_walk(spark, sf_dir):
    """Documents as lines of files in a folder for each language: the folders are walked, and files of 200 documents at most cut up again."""
    path = files.scratch(spark, "folders")
    docs = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.concat_ws(" ", F.col("doc_id").cast("string"), F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("value"))
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 200).text(path)
    found = tables.files(spark, path).filter(F.endswith("path", F.lit(".txt")))
    lines = found.select(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("folder"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).filter("line <> ''")
    at = F.split("line", " ", 2)
    return lines.select(at[0].cast("long").alias("doc_id"), "folder", F.sha2(F.unhex(at[1]), 256).alias("digest"))


@query(f"WITH {COUNTS}, {ELITE} SELECT id, md5(hex) AS pattern_md5, (SELECT sha256(unhex(string_agg(hex, '' ORDER BY id))) FROM elite) AS build FROM elite")
def codebook_file(spark, sf_dir):
    """The codebook as one file, patterns in order of their buckets, opened, checked against its head and read; with the digest of its patterns."""
    book = chunks.elite(chunk_counts(spark, sf_dir), 8, 4096).select(F.lit("elite").alias("book"), "id", "data")
    path = files.scratch(spark, "codebook")
    manifest = files.kept(datasets.write_codebooks(book, path), "manifest")
    back = datasets.read_codebooks(spark, path, manifest).join(manifest.select("book", "sha256"), "book")
    return back.select("id", F.md5(F.hex("data")).alias("pattern_md5"), F.col("sha256").alias("build"))


@query(f"""WITH {fixed_sql(128)}, d AS (SELECT a.doc_id, bit_count(xor(unhex(substr(a.hex, 1, length(b.hex)))::BIT, unhex(b.hex)::BIT)) + 4 * (length(a.hex) - length(b.hex)) AS d FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.chunk_no = a.chunk_no + 1)
SELECT doc_id, count(*) AS pairs, sum(d)::BIGINT AS total, min(d)::BIGINT AS nearest, max(d)::BIGINT AS farthest FROM d GROUP BY doc_id""")
def chunk_steps(spark, sf_dir):
    """How far each chunk is from the one after it, in bits; bytes that a shorter last one lacks count eight each."""
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 128).select("doc_id", "chunk_no", "data")
    after = c.select("doc_id", (F.col("chunk_no") - 1).alias("chunk_no"), F.col("data").alias("next"))
    d = c.join(after, ["doc_id", "chunk_no"]).select("doc_id", codebook.byte_distance(F.col("data"), F.col("next")).cast("long").alias("d"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("d").alias("total"), F.min("d").alias("nearest"), F.max("d").alias("farthest"))
