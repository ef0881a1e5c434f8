"""Queries over text and bytes: tokens, TF-IDF, retrieval, content detection, chunks, codebooks, deltas, integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hashloom.functions import bits, calibration, text
from hashloom.operators import bpe, chunks, codebook, lexicon, search
from hashloom.operators.hashing import token_simhash
from hashloom.sources import files

from .sqltext import FOLDED, TOKENS, bags, dist, token_hash

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_distinct({TOKENS}))::BIGINT AS n_distinct, md5(array_to_string({TOKENS}, ' ')) AS tokens_md5 FROM documents")
def tokenize_docs(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1]), ' ')) AS bigrams_md5,
md5(array_to_string(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || '_' || w[i + 1] || '_' || w[i + 2]), ' ')) AS trigrams_md5 FROM t""")
def ngrams(spark, sf_dir):
    t = documents(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.array_join(text.ngrams(F.col("t"), 2), " ")).alias("bigrams_md5"), F.md5(F.array_join(text.ngrams(F.col("t"), 3), " ")).alias("trigrams_md5"))


def _terms(spark, sf_dir):
    return lexicon.term_counts(documents(spark, sf_dir), "doc_id", "text")


def _idf(spark, sf_dir, terms):
    return lexicon.inverse_frequency(terms, "doc_id", documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")))


_IDF = "idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY token)"


@query(f"WITH {bags('documents', 'doc_id')} SELECT token, count(*) AS df FROM terms GROUP BY token")
def doc_freq(spark, sf_dir):
    return _terms(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {bags('documents', 'doc_id')} SELECT doc_id, token, tf FROM terms")
def tf(spark, sf_dir):
    return _terms(spark, sf_dir)


@query(f"WITH {bags('documents', 'doc_id')}, {_IDF} SELECT token, df, round(idf, 6) AS idf, row_number() OVER (ORDER BY df, token) - 1 AS place FROM idf QUALIFY place < 2048")
def idf_vocab_topk(spark, sf_dir):
    """The 2048 rarest tokens, by token among equals."""
    idf = _idf(spark, sf_dir, _terms(spark, sf_dir))
    return lexicon.rarest(idf, 2048).select("token", "df", F.round("idf", 6).alias("idf"), "place")


@query(f"WITH {bags('documents', 'doc_id')}, {_IDF}, w AS (SELECT doc_id, token, tf * idf AS w FROM terms JOIN idf USING (token)), n AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY doc_id) SELECT doc_id, token, round(w / n, 6) AS weight FROM w JOIN n USING (doc_id)")
def tfidf_norm(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    return lexicon.weighted(terms, _idf(spark, sf_dir, terms), "doc_id").select("doc_id", "token", F.round("weight", 6).alias("weight"))


@query(f"WITH {bags('documents', 'doc_id')}, v AS (SELECT DISTINCT token FROM terms), {bags('benchmark', 'item_id').replace('terms AS', 'probe AS')} SELECT item_id, sum(tf)::BIGINT AS n, coalesce(sum(CASE WHEN v.token IS NULL THEN tf END), 0)::BIGINT AS unknown FROM probe LEFT JOIN v USING (token) GROUP BY item_id")
def oov_stats(spark, sf_dir):
    known = _terms(spark, sf_dir).select("token").distinct().withColumn("known", F.lit(True))
    probe = lexicon.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text").join(known, "token", "left")
    return probe.groupBy("item_id").agg(F.sum("tf").alias("n"), F.sum(F.when(F.col("known").isNull(), F.col("tf")).otherwise(0)).alias("unknown"))


@query(f"""WITH {bags('conversations', 'conv_id').replace('terms AS', 'talk AS')}, known AS (SELECT DISTINCT token FROM talk),
{bags('benchmark', 'item_id').replace('terms AS', 'probe AS')}, unknown AS (SELECT DISTINCT token FROM probe WHERE length(token) > 2 AND token NOT IN (SELECT token FROM known))
SELECT u.token, min(k.token) AS match FROM unknown u JOIN known k ON abs(length(u.token) - length(k.token)) <= 1 AND levenshtein(u.token, k.token) <= 1 GROUP BY u.token""")
def oov_rescue(spark, sf_dir):
    known = lexicon.term_counts(table(spark, sf_dir, "conversations"), "conv_id", "text").select("token").distinct()
    probe = lexicon.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text").select("token").distinct()
    return lexicon.rescue(probe.join(known, "token", "left_anti"), known)


@query()
def oov_rescue_documents(spark, sf_dir):
    """oov_rescue over the vocabulary of oov_stats, all tokens of the documents; too many for the SQL's join of all pairs."""
    known = _terms(spark, sf_dir).select("token").distinct()
    probe = lexicon.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text").select("token").distinct()
    return lexicon.rescue(probe.join(known, "token", "left_anti"), known)


def _msg(conv, turn):
    """A turn's number as the SQL has it; a turn from 1000 on, whose number would be the next conversation's, has a negative one of its own (conv_id below 2^32)."""
    return F.when(turn < 1000, conv * 1000 + turn).otherwise(-(conv * (1 << 31) + turn))


def turns(spark, sf_dir):
    """Turns, keyed by `at`: conversation and turn."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return t.select(F.struct("conv_id", "turn").alias("at"), _msg(F.col("conv_id"), F.col("turn")).alias("msg"), "conv_id", "turn", "role", "text")


def turn_hashes(spark, sf_dir):
    h = token_simhash(lexicon.term_counts(turns(spark, sf_dir), "at", "text"), "at", "token", "tf")
    return h.select("at", _msg(F.col("at.conv_id"), F.col("at.turn")).alias("msg"), "hash")


_TALK = "talk AS (SELECT conv_id * 1000 + turn AS msg, conv_id, turn, role, text FROM conversations)"
_TURNS = f"{_TALK}, {bags('talk', 'msg')}, {token_hash('terms', 'msg', 'tf', 'hashes')}"


@query(f"WITH {_TURNS} SELECT msg, hash FROM hashes")
def text_simhash(spark, sf_dir):
    return turn_hashes(spark, sf_dir).select("msg", "hash")


@query(f"WITH {_TURNS} SELECT a.msg, CASE WHEN b.hash IS NULL OR b.hash = 0 THEN a.hash ELSE (b.hash & -4294967296) | (a.hash & 4294967295) END AS mixed FROM hashes a LEFT JOIN hashes b ON b.msg = a.msg - 1 AND a.msg % 1000 > 0")
def context_mix(spark, sf_dir):
    """The turn before is an equality join on the turn's number: a conversation of any length is no hot key."""
    h = turn_hashes(spark, sf_dir)
    before = h.select(F.struct(F.col("at.conv_id").alias("conv_id"), (F.col("at.turn") + 1).alias("turn")).alias("at"), F.col("hash").alias("previous")).filter("at.turn > 0")
    return h.join(before, "at", "left").select("msg", bits.mix_context(F.coalesce("previous", F.lit(0)), F.col("hash")).alias("mixed"))


@query("SELECT q.conv_id, q.turn, md5(q.text) AS question_md5, md5(a.text) AS answer_md5 FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def qa_flatten(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    answers = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.filter("role = 'user'").join(answers, ["conv_id", "turn"]).select("conv_id", "turn", F.md5("text").alias("question_md5"), F.md5("answer").alias("answer_md5"))


@query(f"""WITH {_TURNS}, n AS (SELECT msg, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM talk),
asked AS (SELECT t.msg, hash FROM talk t JOIN hashes h USING (msg) WHERE role = 'user'),
near AS (SELECT q.msg AS query, arg_min(r.msg, ({dist('q.hash', 'r.hash')}, r.msg)) AS id, min({dist('q.hash', 'r.hash')}) AS distance FROM asked q, asked r WHERE q.msg // 1000 % 100 = 0 AND q.msg <> r.msg GROUP BY q.msg)
SELECT query, id, distance, round(100 / (1 + exp(distance - (12 + 6 / log2(greatest(words, 1) + 1)))), 6) AS confidence FROM near JOIN n ON n.msg = query""")
def qa_retrieval(spark, sf_dir):
    """User turns of every hundredth conversation against all user turns; the confidence's middle depends on the query's length."""
    t = turns(spark, sf_dir).filter("role = 'user'")
    h = files.kept(t.select("at", "text").join(turn_hashes(spark, sf_dir), "at"), "turns")
    asked = h.filter("at.conv_id % 100 = 0")
    near = search.nearest(asked.select(F.col("at").alias("query"), F.col("hash").alias("qhash")), h.select(F.col("at").alias("id"), "hash"))
    middle = calibration.length_middle(text.word_count(F.col("text")))
    named = [_msg(F.col(f"{c}.conv_id"), F.col(f"{c}.turn")).alias(c) for c in ("query", "id")]
    return near.join(asked.select(F.col("at").alias("query"), "text"), "query").select(*named, "distance", F.round(calibration.confidence(F.col("distance"), middle, 1.0), 6).alias("confidence"))


@query("SELECT conv_id, turn, round(12 + 6 / log2(greatest(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')), 1) + 1), 6) AS middle FROM conversations")
def query_len_sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(calibration.length_middle(text.word_count(F.col("text"))), 6).alias("middle"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> '')) >= 3) AS s FROM documents)
SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s""")
def sentence_split(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


_BYTES = "SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(strlen(text)), lambda i: substr(hex(encode(text)), (2 * i + 1)::INT, 2))) AS b FROM documents) GROUP BY ALL"


@query(f"WITH c AS ({_BYTES}), n AS (SELECT doc_id, sum(c) AS n FROM c GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n_bytes, round(-sum(c / n * log2(c / n)), 5) AS entropy FROM c JOIN n USING (doc_id) GROUP BY doc_id, n")
def shannon_entropy(spark, sf_dir):
    """Bits per byte; counted in one pass over each text's own bytes, in batches."""
    return bpe.byte_entropy(documents(spark, sf_dir), "doc_id", "text").filter("n_bytes > 0").select("doc_id", "n_bytes", F.round("entropy", 5).alias("entropy"))


#: How content begins, and the kind and hint it is given.
_MAGIC = [("7f454c46", "ELF"), ("504b0304", "ZIP"), ("89504e47", "PNG"), ("ffd8ff", "JPEG"), ("25504446", "PDF"), ("1f8b", "GZIP"), ("28b52ffd", "ZSTD"), ("424d", "BMP")]


@query("""SELECT page_id, CASE WHEN html LIKE '<!DOCTYPE%' OR html LIKE '<html%' THEN 'HTML' WHEN html LIKE '{%' OR html LIKE '[%' THEN 'JSON' WHEN html LIKE '%' || chr(10) || '%' THEN 'LINES' ELSE 'UNKNOWN' END AS kind,
round(length(regexp_replace(html, '[^ -~]', '', 'g')) / greatest(length(html), 1), 6) AS printable FROM pages""")
def format_detect(spark, sf_dir):
    """Magic bytes first, then how the text begins; the share of printable ASCII characters."""
    html = F.coalesce(F.col("html"), F.lit(""))
    begin = F.lower(F.hex(F.encode(F.substring(html, 1, 8), "UTF-8")))
    kind = F.when(html.startswith("<!DOCTYPE") | html.startswith("<html"), "HTML").when(html.startswith("{") | html.startswith("["), "JSON")
    for magic, name in _MAGIC:
        kind = kind.when(begin.startswith(magic), name)
    kind = kind.when(html.contains("\n"), "LINES").otherwise("UNKNOWN")
    printable = F.length(F.regexp_replace(html, "[^ -~]", "")) / F.greatest(F.length(html), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), F.round(printable, 6).alias("printable"))


@query("SELECT event_id, CASE WHEN trim(props) LIKE '{%' THEN 'JSON' WHEN trim(props) LIKE '[%' THEN 'JSON' ELSE 'UNKNOWN' END AS kind, len(json_keys(props))::BIGINT AS n_keys FROM events")
def extension_detect(spark, sf_dir):
    p = F.trim("props")
    return table(spark, sf_dir, "events").select("event_id", F.when(p.startswith("{") | p.startswith("["), "JSON").otherwise("UNKNOWN").alias("kind"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


def fixed_sql(size: int, where: str = "true") -> str:
    return f"c AS (SELECT doc_id, k AS chunk_no, substr(hex(encode(text)), ({2 * size} * k + 1)::INT, {2 * size}) AS hex FROM documents, LATERAL unnest(range((strlen(text) + {size - 1}) // {size})) t(k) WHERE {where})"


@query(f"WITH {fixed_sql(128)} SELECT doc_id, chunk_no, chunk_no * 128 AS off, length(hex) // 2 AS size, md5(hex) AS chunk_md5 FROM c")
def fixed_chunks(spark, sf_dir):
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 128)
    return c.select("doc_id", "chunk_no", "off", F.length("data").cast("long").alias("size"), F.md5(F.hex("data")).alias("chunk_md5"))


def chunk_counts(spark, sf_dir, where="true"):
    return chunks.frequency(chunks.fixed(documents(spark, sf_dir).filter(where), "doc_id", "text", 128).filter(F.length("data") == 128))


COUNTS = f"{fixed_sql(128)}, n AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 GROUP BY hex)"


@query(f"WITH {COUNTS} SELECT md5(hex) AS chunk_md5, n FROM n")
def chunk_frequency(spark, sf_dir):
    return chunk_counts(spark, sf_dir).select(F.md5(F.hex("data")).alias("chunk_md5"), "n")


_BUCKET = "(('0x' || substr(hex, 1, 2))::INT + 256 * ('0x' || substr(hex, 3, 2))::INT)::BIGINT"
ELITE = f"b AS (SELECT *, {_BUCKET} AS bucket FROM n), cut AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, hex) <= 8), top AS (SELECT * FROM cut ORDER BY n DESC, hex LIMIT 4096), elite AS (SELECT row_number() OVER (ORDER BY bucket, n DESC, hex) - 1 AS id, bucket, n, hex FROM top)"


@query(f"WITH {COUNTS}, {ELITE} SELECT id, bucket, n, md5(hex) AS chunk_md5 FROM elite")
def codebook_elite(spark, sf_dir):
    return chunks.elite(chunk_counts(spark, sf_dir), 8, 4096).select("id", "bucket", "n", F.md5(F.hex("data")).alias("chunk_md5"))


@query(f"""WITH {COUNTS}, v AS (SELECT substr(hex, 3) || '00' AS hex, greatest(n // 2, 1) AS n FROM n WHERE n > 1 UNION ALL SELECT '00' || substr(hex, 1, length(hex) - 2), greatest(n // 2, 1) FROM n WHERE n > 1
UNION ALL SELECT substr(hex, 3) || substr(hex, 1, 2), greatest(n // 2, 1) FROM n WHERE n > 1 UNION ALL SELECT hex, n FROM n) SELECT md5(hex) AS chunk_md5, sum(n)::BIGINT AS n FROM v GROUP BY hex""")
def codebook_augment(spark, sf_dir):
    return chunks.augmented(chunk_counts(spark, sf_dir)).select(F.md5(F.hex("data")).alias("chunk_md5"), "n")


@query(f"""WITH {fixed_sql(128)}, e AS (SELECT hex, count(*) + 100 AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 0 GROUP BY hex), o AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 1 GROUP BY hex)
SELECT md5(hex) AS chunk_md5, sum(n)::BIGINT AS n, max(base) AS old FROM (SELECT hex, n, true AS base FROM e UNION ALL SELECT hex, n, false FROM o) GROUP BY hex""")
def codebook_merge(spark, sf_dir):
    """Incremental training: patterns of the first codebook (even documents) are seeded with 100 more."""
    base = chunk_counts(spark, sf_dir, "doc_id % 2 = 0").select("data", (F.col("n") + 100).alias("n"), F.lit(True).alias("base"))
    new = chunk_counts(spark, sf_dir, "doc_id % 2 = 1").select("data", "n", F.lit(False).alias("base"))
    return base.unionByName(new).groupBy("data").agg(F.sum("n").alias("n"), F.max("base").alias("old")).select(F.md5(F.hex("data")).alias("chunk_md5"), "n", "old")


_TRAIN = f"{fixed_sql(128)}, book AS (SELECT DISTINCT hex FROM c WHERE doc_id % 2 = 0 AND length(hex) = 256)"


@query(f"WITH {_TRAIN} SELECT doc_id, count(*) AS n_chunks, count(book.hex) AS hits, (24 * count(*) + coalesce(sum(CASE WHEN book.hex IS NULL THEN length(c.hex) // 2 END), 0))::BIGINT AS packed_bytes FROM c LEFT JOIN book USING (hex) WHERE doc_id % 2 = 1 GROUP BY doc_id")
def pack_cost(spark, sf_dir):
    """Odd documents packed with a codebook of the even ones: 24 bytes a pointer, and the bytes of chunks it does not have."""
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 128)
    book = c.filter((F.col("doc_id") % 2 == 0) & (F.length("data") == 128)).select("data").distinct().withColumn("known", F.lit(1))
    hit = c.filter("doc_id % 2 = 1").join(book, "data", "left")
    literal = F.sum(F.when(F.col("known").isNull(), F.length("data")).otherwise(0))
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("known").alias("hits"), (24 * F.count(F.lit(1)) + literal).cast("long").alias("packed_bytes"))


@query("SELECT doc_id, sha256(text) AS digest, true AS whole FROM documents WHERE strlen(text) > 0")
def reassemble_verify(spark, sf_dir):
    """Chunks put together again in order give the digest of the original."""
    docs = documents(spark, sf_dir)
    c = chunks.fixed(docs, "doc_id", "text", 4096)
    back = c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", F.hex("data").alias("hex")))), lambda x: x["hex"]), "").alias("hex"))
    digest = F.sha2(F.unhex("hex"), 256)
    return back.join(docs, "doc_id").select("doc_id", digest.alias("digest"), (digest == F.sha2(F.encode("text", "UTF-8"), 256)).alias("whole"))


@query("SELECT doc_id, md5(substr(hex(encode(text)), 2001, 1000)) AS range_md5 FROM documents WHERE strlen(text) > 1000")
def range_read(spark, sf_dir):
    """Bytes 1000 to 1499 of every document, from only the chunks that hold them."""
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 128).filter("chunk_no BETWEEN 1000 DIV 128 AND 1499 DIV 128")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", F.hex("data").alias("hex")))), lambda x: x["hex"]), "")
    cut = F.substr("hex", F.lit(2 * (1000 % 128) + 1), F.lit(1000))
    return c.groupBy("doc_id").agg(joined.alias("hex")).select("doc_id", cut.alias("cut")).filter("cut <> ''").select("doc_id", F.md5("cut").alias("range_md5"))


def _leaves(spark, sf_dir):
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 4096)
    rows = c.select("doc_id", F.col("chunk_no").alias("idx"), F.sha2("data", 256).alias("hash"))
    last = rows.groupBy("doc_id").agg(F.max("idx").alias("last"))
    return rows.join(last, "doc_id")


@query(f"""WITH RECURSIVE {fixed_sql(4096)}, t AS (SELECT doc_id, chunk_no AS i, count(*) OVER (PARTITION BY doc_id) AS n, sha256(unhex(hex)) AS h, count(*) OVER (PARTITION BY doc_id) AS n_leaves FROM c
UNION ALL SELECT doc_id, i // 2, (n + 1) // 2, sha256(unhex(min_by(h, i) || max_by(h, i))), n_leaves FROM t WHERE n > 1 GROUP BY doc_id, i // 2, n, n_leaves)
SELECT doc_id, h AS root, n_leaves FROM t WHERE n = 1""")
def merkle_root(spark, sf_dir):
    return chunks.merkle_root(_leaves(spark, sf_dir), "doc_id")


_CHANGED = fixed_sql(512)


@query(f"WITH {_CHANGED} SELECT doc_id, chunk_no AS idx FROM c WHERE chunk_no % 3 = doc_id % 3 AND hex <> upper(hex(encode(repeat('x', (length(hex) // 2)::INT))))")
def merkle_leaves_diff(spark, sf_dir):
    """Leaves that differ from a copy in which every third chunk is overwritten."""
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 512)
    other = c.withColumn("data", F.when(F.col("chunk_no") % 3 == F.col("doc_id") % 3, F.encode(F.repeat(F.lit("x"), F.length("data")), "UTF-8")).otherwise(F.col("data")))
    a, b = c.select("doc_id", "chunk_no", F.sha2("data", 256).alias("a")), other.select("doc_id", "chunk_no", F.sha2("data", 256).alias("b"))
    return a.join(b, ["doc_id", "chunk_no"]).filter("a <> b").select("doc_id", F.col("chunk_no").alias("idx"))


@query(f"WITH {fixed_sql(512)}, have AS (SELECT DISTINCT hex FROM c WHERE doc_id % 2 = 0) SELECT doc_id, chunk_no, length(hex) // 2 AS size FROM c WHERE doc_id % 2 = 1 AND hex NOT IN (SELECT hex FROM have)")
def manifest_diff(spark, sf_dir):
    """Chunks of the odd documents that a peer with the even ones lacks, with their places."""
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 512).withColumn("digest", F.sha2("data", 256))
    return c.filter("doc_id % 2 = 1").join(c.filter("doc_id % 2 = 0").select("digest"), "digest", "left_anti").select("doc_id", "chunk_no", F.length("data").cast("long").alias("size"))


@query(f"WITH {fixed_sql(64)}, x AS (SELECT a.doc_id, a.chunk_no, a.hex AS a, b.hex AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.chunk_no = a.chunk_no + 1) SELECT doc_id, chunk_no, md5(hex(xor(unhex(a)::BIT, unhex(left(b || repeat('00', 64), length(a)))::BIT)::BLOB)) AS delta_md5, md5(a) AS pattern_md5, true AS same FROM x")
def xor_delta_roundtrip(spark, sf_dir):
    """Each chunk as the XOR with the next one, and back."""
    rows = chunks.beside(documents(spark, sf_dir), "doc_id", "text", 64).withColumn("delta", codebook.xored("data", "pattern"))
    rows = rows.withColumn("back", codebook.xored("delta", "pattern"))
    return rows.select("doc_id", "chunk_no", F.md5(F.hex("delta")).alias("delta_md5"), F.md5(F.hex("back")).alias("pattern_md5"), (F.col("back") == F.col("data")).alias("same"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS line, len(string_split(text, chr(10))) AS n FROM documents),
b AS (SELECT doc_id, line, CASE WHEN line < n - 1 THEN hex(encode(t)) || '0A' ELSE hex(encode(t)) END AS hex FROM l)
SELECT doc_id, line, part, md5(substr(hex, (2048 * part + 1)::INT, 2048)) AS chunk_md5 FROM b, LATERAL unnest(range((length(hex) // 2 + 1023) // 1024)) t(part)""")
def delimiter_chunks(spark, sf_dir):
    return chunks.delimited(documents(spark, sf_dir), "doc_id", "text").select("doc_id", "line", "part", F.md5(F.hex("data")).alias("chunk_md5"))


@query()
def cdc_chunks(spark, sf_dir):
    """Content-defined chunks: cut where a rolling hash of the last bytes has its low bits clear."""
    return bpe.content_chunks(documents(spark, sf_dir), "doc_id", "text", 512)


def _words(spark, sf_dir, name):
    return table(spark, sf_dir, name).select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query()
def bpe_train(spark, sf_dir):
    """Merges learnt from all distinct words of the documents."""
    return spark.createDataFrame(bpe.train(_words(spark, sf_dir, "documents"), 60), "rank long, left string, right string, n long")


@query()
def bpe_encode(spark, sf_dir):
    """All distinct words of the documents in symbols learnt from them, and read back."""
    learnt = files.kept(_words(spark, sf_dir, "documents"), "words")
    merges = bpe.train(learnt, 60)
    names = bpe.symbols(learnt, merges)
    coded = bpe.encode(learnt, merges, names)
    return coded.select("word", "n", "ids", bpe.decode(F.col("ids"), names).alias("decoded"))


@query(f"WITH {bags('documents', 'doc_id')}, n AS (SELECT token, sum(tf) AS n FROM terms GROUP BY token), top AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS r FROM n QUALIFY r <= 8), p AS (SELECT token, r, n / (SELECT sum(n) FROM top) AS p FROM top) SELECT token, round(p, 6) AS p, round(sum(p) OVER (ORDER BY r), 6) AS upto FROM p")
def topk_sampling(spark, sf_dir):
    """The eight likeliest tokens, renormalised, with the running sum that inverse sampling looks up."""
    top = _terms(spark, sf_dir).groupBy("token").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "token").limit(8)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # of eight rows
    p = top.withColumn("p", F.col("n") / F.sum("n").over(every))
    return p.select("token", F.round("p", 6).alias("p"), F.round(F.sum("p").over(Window.orderBy(F.desc("n"), "token").rowsBetween(Window.unboundedPreceding, 0)), 6).alias("upto"))


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all({FOLDED}, '[a-z0-9]+') AS w FROM conversations), p AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t)
SELECT conv_id, turn, i AS place, md5(array_to_string(list_transform(range(i - 4, i + 5), lambda k: CASE WHEN k BETWEEN 1 AND len(w) THEN w[k] ELSE '[MASK]' END), ' ')) AS context_md5 FROM p""")
def masked_context(spark, sf_dir):
    """Windows of four tokens to each side, filled with the mask at the ends."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    p = t.select("conv_id", "turn", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    around = F.transform(F.sequence(F.col("i") - 4, F.col("i") + 4), lambda k: F.when((k >= 1) & (k <= F.size("w")), F.get(F.col("w"), k - 1)).otherwise("[MASK]"))
    return p.select("conv_id", "turn", F.col("i").cast("long").alias("place"), F.md5(F.array_join(around, " ")).alias("context_md5"))
