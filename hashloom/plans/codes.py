"""Queries over codebooks, edit scripts, sealed chunks and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import bits
from hashloom.operators import bytemerges, chunks, codebook, denoise, edits, projection, search
from hashloom.sources import files, tensors

from .texts import COUNTS, ELITE, chunk_counts, documents, fixed_sql, format_detect, table

QUERIES, SQL = {}, {}

#: A registry of codebooks: name, category, hint, bytes of a codeword.
BOOKS = [("html-128", "HTML", "markup", 128), ("lines-128", "LINES", "log", 128), ("markup-128", "XML", "markup", 128), ("plain-128", "universal", "", 128)]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def asked(spark, sf_dir):
    """The stated query set: whole chunks of every hundredth document; and the codebook of all documents."""
    c = chunks.fixed(documents(spark, sf_dir).filter("doc_id % 100 = 0"), "doc_id", "text", 128).filter(F.length("data") == 128)
    return c.select("doc_id", "chunk_no", "data"), chunks.elite(chunk_counts(spark, sf_dir), 8, 4096).select("id", "bucket", "data")


_KEYS = ["doc_id", "chunk_no"]
_DISTANCE = "bit_count(xor(unhex(q.hex)::BIT, unhex(b.hex)::BIT))::BIGINT"
_ASKED = f"{COUNTS}, {ELITE}, q AS (SELECT doc_id, chunk_no, hex FROM c WHERE doc_id % 100 = 0 AND length(hex) = 256), d AS (SELECT doc_id, chunk_no, b.id, b.bucket, {_DISTANCE} AS distance, substr(q.hex, 1, 4) = substr(b.hex, 1, 4) AS same FROM q, elite b)"


@query(f"WITH {_ASKED} SELECT doc_id, chunk_no, arg_min(id, (distance, id)) AS id, min(distance) AS distance, round(1 - min(distance) / 1024, 6) AS similarity FROM d GROUP BY doc_id, chunk_no")
def codeword_nearest(spark, sf_dir):
    found = codebook.nearest_linear(*asked(spark, sf_dir), _KEYS)
    return found.select(*_KEYS, "id", "distance", F.round(codebook.similarity(F.col("distance"), F.lit(1024)), 6).alias("similarity"))


@query(f"WITH {_ASKED}, h AS (SELECT *, bool_or(same) OVER (PARTITION BY doc_id, chunk_no) AS has FROM d) SELECT doc_id, chunk_no, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM h WHERE same OR NOT has GROUP BY doc_id, chunk_no")
def codeword_bucketed(spark, sf_dir):
    return codebook.nearest_bucketed(*asked(spark, sf_dir), _KEYS)


@query(f"""WITH {_ASKED}, t AS (SELECT doc_id, chunk_no, id % 3 AS tier, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM d GROUP BY doc_id, chunk_no, id % 3),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY CASE WHEN distance <= 512 THEN tier ELSE 3 END, distance, tier) AS r FROM t)
SELECT doc_id, chunk_no, tier, id, distance FROM r WHERE r = 1""")
def codeword_tiered(spark, sf_dir):
    q, book = asked(spark, sf_dir)
    book = files.kept(book, "book")
    return codebook.nearest_tiered(q, [book.filter(F.col("id") % 3 == k) for k in range(3)], _KEYS, 1024)


@query("""SELECT page_id, CASE WHEN html LIKE '<!DOCTYPE%' OR html LIKE '<html%' THEN 'html-128' WHEN html LIKE '{%' OR html LIKE '[%' THEN 'plain-128' WHEN html LIKE '%' || chr(10) || '%' THEN 'lines-128' ELSE 'plain-128' END AS book FROM pages""")
def codebook_route(spark, sf_dir):
    """The codebook that each page's kind is packed with."""
    books = spark.createDataFrame(BOOKS, "book string, category string, hint string, size long")
    rows = format_detect(spark, sf_dir).select("page_id", F.col("kind").alias("category"), F.lit("none").alias("hint"), F.lit(128).cast("long").alias("size"))
    return codebook.route(rows, books).select("page_id", "book")


@query(f"WITH {fixed_sql(64)} SELECT a.doc_id, a.chunk_no, md5(a.hex) AS chunk_md5, true AS same FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.chunk_no = a.chunk_no + 1")
def edit_delta_roundtrip(spark, sf_dir):
    """Each chunk as an edit script against the next one, and back."""
    back = edits.patch(F.col("pattern"), edits.diff(F.col("pattern"), F.col("data")))
    rows = chunks.beside(documents(spark, sf_dir), "doc_id", "text", 64).select(*_KEYS, "data", back.alias("back"))
    return rows.select(*_KEYS, F.md5(F.hex("back")).alias("chunk_md5"), (F.col("back") == F.col("data")).alias("same"))


@query(f"WITH {fixed_sql(128)} SELECT md5(hex) AS chunk_md5, count(*) AS n, 1::BIGINT AS sealed_forms, length(hex) // 2 + 28 AS sealed_bytes, true AS whole FROM c GROUP BY hex")
def convergent_seal(spark, sf_dir):
    """Chunks sealed under keys of their own content: equal chunks have one sealed form, and each opens again."""
    secret = b"a secret that both peers know"
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 128).select("data", codebook.seal(F.col("data"), secret).alias("sealed"))
    back = codebook.unseal(F.col("sealed"), F.unhex(F.sha2("data", 256)), secret)
    forms = c.groupBy("data", "sealed").agg(F.count(F.lit(1)).alias("n"), F.bool_and(back == F.col("data")).alias("whole"))
    return forms.groupBy("data").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sealed_forms"), F.max(F.length("sealed")).cast("long").alias("sealed_bytes"), F.bool_and("whole").alias("whole")).select(F.md5(F.hex("data")).alias("chunk_md5"), "n", "sealed_forms", "sealed_bytes", "whole")


def _components(spark, sf_dir, count):
    rows = table(spark, sf_dir, "embeddings")
    n, mean, covariance = projection.moments(rows, "embedding", 64)
    return rows, mean, *projection.principal(covariance, count)


@query()
def pca_components(spark, sf_dir):
    _, _, variances, vectors = _components(spark, sf_dir, 8)
    return spark.createDataFrame([(k, float(v), [float(x) for x in w]) for k, (v, w) in enumerate(zip(variances, vectors, strict=True))], "component long, variance double, weights array<double>")


@query()
def pca_hash(spark, sf_dir):
    """Sign bits of all 64 components of the centred vectors."""
    rows, mean, _, vectors = _components(spark, sf_dir, 64)
    h = projection.projected_hash(F.col("embedding"), mean, vectors)
    return rows.select("vec_id", h.alias("hash")).withColumn("bucket", bits.prefix(F.col("hash"), 8).cast("long"))


@query("""WITH s AS (SELECT q.vec_id AS query, r.vec_id AS id, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0),
m AS (SELECT query, max(s) AS m FROM s GROUP BY query), z AS (SELECT query, sum(exp(s - m)) AS z FROM s JOIN m USING (query) GROUP BY query)
SELECT query, round(max(exp(s - m) / z), 5) AS top, round(-ln(greatest(max(CASE WHEN id = query THEN exp(s - m) / z END), 1e-10)), 5) AS loss FROM s JOIN m USING (query) JOIN z USING (query) GROUP BY query""")
def softmax_loss(spark, sf_dir):
    """Softmax of the stated queries' products with all rows, shifted by the largest, and the cross-entropy of each with itself."""
    rows = table(spark, sf_dir, "embeddings")
    q = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("a"))
    e = search.softmax(q, rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("b")))
    own = F.exp(F.col("own") - F.col("m")) / F.col("z")
    return e.select("query", F.round(1 / F.col("z"), 5).alias("top"), F.round(-F.ln(F.greatest(own, F.lit(1e-10))), 5).alias("loss"))


_CUT = "(?:..){{32}}(?:{other}){{0,223}}(?:{ends})|(?:..){{1,256}}"
_LINES, _JSON = _CUT.format(other="[1-9A-F].|0[0-9B-F]", ends="0A"), _CUT.format(other="[013-689A-F].|2[0-9ABD-F]|7[0-9A-CEF]", ends="7D|2C")


@query(f"""WITH h AS (SELECT doc_id, hex(encode(text)) AS hex, CASE WHEN text LIKE '%' || chr(10) || '%' THEN 'LINES' WHEN text LIKE '%,%' THEN 'JSON' ELSE 'UNKNOWN' END AS kind FROM documents),
p AS (SELECT doc_id, CASE kind WHEN 'LINES' THEN regexp_extract_all(hex, '{_LINES}') WHEN 'JSON' THEN regexp_extract_all(hex, '{_JSON}') ELSE regexp_extract_all(hex, '(?:..){{1,256}}') END AS p FROM h)
SELECT doc_id, chunk_no, md5(hex) AS chunk_md5 FROM (SELECT doc_id, unnest(p) AS hex, unnest(range(len(p))) AS chunk_no FROM p)""")
def contextual_chunks(spark, sf_dir):
    """Chunks that end where a line or a member does, by what a text looks like."""
    kind = F.when(F.contains("text", F.lit("\n")), "LINES").when(F.contains("text", F.lit(",")), "JSON").otherwise("UNKNOWN")
    c = chunks.contextual(documents(spark, sf_dir).withColumn("kind", kind), "doc_id", "text", "kind", 256)
    return c.select("doc_id", "chunk_no", F.md5(F.hex("data")).alias("chunk_md5"))


@query(f"""WITH {fixed_sql(4)}, d AS (SELECT hex, count(*) AS n, length(hex) // 2 AS size, ('0x' || substr(hex, 1, 2))::INT AS c, TRY_CAST('0x' || substr(hex, 3, 2) AS INT) AS d, TRY_CAST('0x' || substr(hex, 5, 2) AS INT) AS e, TRY_CAST('0x' || substr(hex, 7, 2) AS INT) AS f FROM c GROUP BY hex),
t AS (SELECT *, CASE WHEN size = 1 THEN 0 ELSE (d - c - a + 512) % 256 END AS b FROM d, range(256) r(a) WHERE size > 1 OR a = 0)
SELECT hex, max(n) AS n, min(a + 256 * b + 65536 * c)::BIGINT AS seed FROM t WHERE (size < 3 OR (4 * a + 2 * b + c) % 256 = e) AND (size < 4 OR (9 * a + 3 * b + c) % 256 = f) GROUP BY hex, c HAVING min(a) IS NOT NULL""".replace("min(a + 256 * b + 65536 * c)", "arg_min(a + 256 * b + 65536 * c, a)"))
def polynomial_fit(spark, sf_dir):
    """Pieces of four bytes that a polynomial generates, with its seed and how often they come."""
    counts = chunks.frequency(chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 4))
    return counts.select(F.hex("data").alias("hex"), "n", chunks.polynomial(F.col("data")).alias("seed")).filter("seed IS NOT NULL")


@query("SELECT vec_id DIV 256 AS file, vec_id::VARCHAR AS name, len(embedding)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings".replace("DIV", "//"))
def tensor_container(spark, sf_dir):
    """Vectors in containers of 256 named tensors, and read from them again."""
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id DIV 256").alias("file"), F.col("vec_id").cast("string").alias("name"), F.array(F.size("embedding")).alias("shape"), F.col("embedding").alias("values"))
    back = tensors.unpacked(tensors.packed(rows, "file", b"TNSR"), "file", b"TNSR")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("file", "name", F.element_at("shape", 1).cast("long").alias("n"), F.round(total, 5).alias("total"))


def _language_model(spark, sf_dir, epochs):
    rows = denoise.corpus(table(spark, sf_dir, "conversations"), "text")
    words = denoise.vocabulary(rows, 2048)
    return words, *denoise.train(rows, words, epochs)


@query()
def denoise_training(spark, sf_dir):
    """Mean loss of the masked words, by epoch."""
    return spark.createDataFrame([(e, float(x), n) for e, x, n in _language_model(spark, sf_dir, 4)[2]], "epoch long, loss double, n long")


@query()
def denoise_generate(spark, sf_dir):
    """Eight places after each benchmark item, filled by a model trained on the conversations."""
    words, w, _ = _language_model(spark, sf_dir, 4)
    return denoise.generate(table(spark, sf_dir, "benchmark"), "item_id", "text", w, words, 8)


@query(f"WITH {fixed_sql(128)} SELECT doc_id, chunk_no, md5(hex) AS opened_md5, length(hex) // 2 + 28 AS locked_bytes, true AS wrong_key_fails FROM c")
def password_lock(spark, sf_dir):
    """Chunks locked under a stretched password, opened again, and not opened by another one."""
    key, other = (codebook.stretched(p, b"sixteen byte salt"[:16]) for p in (b"a password", b"another"))
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 128).select(*_KEYS, codebook.lock(F.col("data"), key).alias("locked"))
    opened = F.md5(F.hex(codebook.unlock(F.col("locked"), key)))
    return c.select(*_KEYS, opened.alias("opened_md5"), F.length("locked").cast("long").alias("locked_bytes"), codebook.unlock(F.col("locked"), other).isNull().alias("wrong_key_fails"))


@query("SELECT conv_id, turn, round(list_sum(list_transform(range(len(w)), lambda k: sin(w[k + 1]))), 4) AS first, round(list_sum(list_transform(range(len(w)), lambda k: sin(w[k + 1] + 7 * k))), 4) AS eighth, round(list_sum(list_transform(range(256), lambda i: ((i * 17 + 5) % 21 - 10) / 10 * list_sum(list_transform(range(len(w)), lambda k: sin(w[k + 1] + i * k))))), 4) AS logit FROM (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS w FROM conversations)")
def sine_state(spark, sf_dir):
    """A stand-in for a model's hidden state: sines of token numbers (here: lengths of words) and places; and its product with one row of weights."""
    w = F.transform(F.split("text", " "), lambda x: F.length(x))
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", projection.sine_state(w).alias("h"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((i * 17 + 5) % 21 - 10) / 10)
    logit = F.aggregate(F.zip_with("h", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select("conv_id", "turn", F.round(F.get("h", F.lit(0)), 4).alias("first"), F.round(F.get("h", F.lit(7)), 4).alias("eighth"), F.round(logit, 4).alias("logit"))


@query()
def byte_merges(spark, sf_dir):
    """Byte merges for a codebook, learnt from all documents: id, what it joins, how often, its bytes."""
    merges = bytemerges.train(documents(spark, sf_dir), "text", 24)
    names = bytemerges.table(merges)
    return spark.createDataFrame([(*m, names[m[0]].hex()) for m in merges], "id long, left long, right long, n long, hex string")


@query()
def byte_encode(spark, sf_dir):
    """All documents in a small model's byte merges, and read back."""
    docs = documents(spark, sf_dir)
    merges = bytemerges.train(docs, "text", 24, bytemerges.MODEL)
    coded = docs.select("doc_id", "text", bytemerges.encode(F.col("text"), merges).alias("ids"))
    back = bytemerges.decode(F.col("ids"), bytemerges.table(merges, bytemerges.MODEL))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.md5(back).alias("decoded_md5"))


@query()
def denoise_reverse(spark, sf_dir):
    """What the model makes of masks alone, in twenty steps, for each length up to 32."""
    words, w, _ = _language_model(spark, sf_dir, 4)
    return denoise.unmask(spark.range(1, 33).select(F.col("id").alias("n")), "n", w, words)
