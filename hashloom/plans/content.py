"""Queries over bytes: kinds of content, entropy gates, codebooks that pack and rebuild, chunkers, small text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import content, text
from hashloom.operators import bpe, cascade, chunks, codebook

from .sqltext import TOKENS
from .texts import COUNTS, ELITE, chunk_counts, documents, fixed_sql, pack_cost, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: What is put before a text to make a file of each kind, in hex.
_STARTS = ["", "7b2261223a317d0a7b", "7b2262223a", "7f454c46", "504b0304", "89504e47", "1f8b08", "ffd8ffe0", "474946383961", "424d", "49492a00", "255044462d"]
_HEADS = "list_element([" + ", ".join(f"'{x.upper()}'" for x in _STARTS) + "], (doc_id % 12 + 1)::INT)"
_MAGIC_SQL = " ".join(f"WHEN starts_with(hex, '{m.upper()}') THEN {{'category': '{c}', 'hint': '{h}', 'confidence': {s}::DOUBLE}}" for m, c, h, s in content.MAGIC)


@query(f"""WITH p AS (SELECT doc_id, text, {_HEADS} || hex(encode(text)) AS hex FROM documents), s AS (SELECT *, CASE WHEN doc_id % 12 = 0 THEN substr(text, 1, 8192) WHEN doc_id % 12 = 1 THEN substr('{{"a":1}}' || chr(10) || '{{' || text, 1, 8192) WHEN doc_id % 12 = 2 THEN substr('{{"b":' || text, 1, 8192) WHEN doc_id % 12 >= 6 THEN substr(repeat('x', list_element([3, 4, 6, 2, 4, 5], (doc_id % 12 - 5)::INT)) || text, 1, 8192) END AS sample FROM p),
k AS (SELECT *, CASE WHEN hex = '' THEN {{'category': 'empty', 'hint': 'none', 'confidence': 1.0::DOUBLE}} {_MAGIC_SQL}
WHEN contains(sample, '<svg') OR contains(upper(sample), 'XML') THEN {{'category': 'raw_image', 'hint': 'svg', 'confidence': 0.8::DOUBLE}}
WHEN regexp_matches(upper(sample), 'SELECT |INSERT INTO |CREATE TABLE ') THEN {{'category': 'text_sql', 'hint': 'sql', 'confidence': 0.8::DOUBLE}}
WHEN regexp_matches(sample, 'func |class |def |package |import |function ') THEN {{'category': 'text_code', 'hint': 'code', 'confidence': 0.7::DOUBLE}}
WHEN length(regexp_replace(sample, '[^ -~\\n\\r\\t]', '', 'g')) / strlen(sample) > 0.85 THEN {{'category': 'text_logs', 'hint': 'text', 'confidence': 0.7::DOUBLE}}
ELSE {{'category': 'binary', 'hint': 'unknown', 'confidence': 0.3::DOUBLE}} END AS found FROM s)
SELECT doc_id, found.category AS category, found.hint AS hint, found.confidence AS confidence,
CASE WHEN hex = '' THEN 'UNKNOWN' WHEN starts_with(hex, '7F454C46') THEN 'ELF' WHEN starts_with(hex, '504B0304') THEN 'ZIP' WHEN starts_with(hex, '89504E47') THEN 'PNG'
WHEN regexp_matches(sample, '^[ \\t\\n\\r]*[{{\\[]') THEN CASE WHEN contains(sample, '}}' || chr(10) || '{{') THEN 'JSONL' ELSE 'JSON' END
WHEN sample IS NOT NULL AND length(sample) - length(replace(sample, chr(10), '')) > 5 THEN 'LINES' ELSE 'UNKNOWN' END AS extension FROM k""")
def content_kinds(spark, sf_dir):
    """Texts, and texts behind the first bytes of other kinds of file: category, hint, confidence, and the extension that they look like."""
    start = F.element_at(F.array(*(F.lit(x) for x in _STARTS)), (F.col("doc_id") % 12 + 1).cast("int"))
    data = documents(spark, sf_dir).select("doc_id", F.concat(F.unhex(start), F.encode("text", "UTF-8")).alias("data"))
    kind = data.select("doc_id", content.detected(F.col("data")).alias("k"), content.extension(F.col("data")).alias("extension"))
    return kind.select("doc_id", "k.category", "k.hint", "k.confidence", "extension")


_PAYLOADS = f"""p AS (SELECT doc_id, 'text' AS kind, hex(encode(text)) AS hex FROM documents UNION ALL SELECT doc_id, 'flat', upper(repeat('61', 600)) FROM documents 
UNION ALL SELECT doc_id, 'noise', upper(array_to_string(list_transform(range(256), lambda i: md5(doc_id || ':' || i)), '')) FROM documents),
b AS (SELECT doc_id, kind, b, count(*) AS c FROM (SELECT doc_id, kind, unnest(list_transform(range(length(hex) // 2), lambda i: substr(hex, (2 * i + 1)::INT, 2))) AS b FROM p) GROUP BY ALL),
n AS (SELECT doc_id, kind, sum(c) AS n FROM b GROUP BY ALL), e AS (SELECT doc_id, kind, -sum(c / n * log2(c / n)) AS e FROM b JOIN n USING (doc_id, kind) GROUP BY ALL)"""


@query(f"WITH {_PAYLOADS} SELECT doc_id, kind, abs(round(e, 5)) AS entropy, e > 7.5 AS skips_search, e > 7.8 AS passes_through, e < 1.0 AS flat FROM e")
def entropy_bypass(spark, sf_dir):
    """Gates on bits per byte: of every text, of one repeated letter, and of 4096 bytes of digests."""
    docs = documents(spark, sf_dir)
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string")))), ""))
    payloads = F.array(*(F.struct(F.lit(k).alias("kind"), d.alias("data")) for k, d in (("text", F.encode("text", "UTF-8")), ("flat", F.encode(F.repeat(F.lit("a"), F.lit(600)), "UTF-8")), ("noise", noise))))
    rows = docs.select("doc_id", F.inline(payloads)).filter(F.length("data") > 0)
    e = rows.select("doc_id", "kind", bpe.entropy(F.col("data")).alias("e"))
    return e.select("doc_id", "kind", F.round("e", 5).alias("entropy"), (F.col("e") > 7.5).alias("skips_search"), content.passes_through(F.col("e")).alias("passes_through"), (F.col("e") < 1.0).alias("flat"))


_EVEN = f"{fixed_sql(128)}, n AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 0 GROUP BY hex), {ELITE}"
_PACKED = f"""{_EVEN}, q AS (SELECT doc_id, chunk_no, hex FROM c WHERE doc_id % 2 = 1 AND length(hex) = 256),
d AS (SELECT q.doc_id, q.chunk_no, q.hex, min(struct_pack(distance := bit_count(xor(unhex(q.hex)::BIT, unhex(e.hex)::BIT))::BIGINT, id := e.id, pattern := e.hex)) AS m FROM q LEFT JOIN elite e ON substr(q.hex, 1, 4) = substr(e.hex, 1, 4) GROUP BY ALL),
k AS (SELECT doc_id, chunk_no, hex, m, CASE WHEN m.id IS NULL OR 1 - m.distance / 1024 <= 0.2 THEN 'literal' WHEN 1 - m.distance / 1024 > 0.95 THEN 'hit' ELSE 'delta' END AS decision FROM d)"""


def packed(spark, sf_dir):
    """Whole chunks of odd documents against a codebook of the even ones: decision, codeword and delta."""
    book = chunks.elite(chunk_counts(spark, sf_dir, "doc_id % 2 = 0"), 8, 4096).select("id", "data")
    c = chunks.fixed(documents(spark, sf_dir).filter("doc_id % 2 = 1"), "doc_id", "text", 128).filter(F.length("data") == 128)
    return codebook.packed(c, book, ["doc_id", "chunk_no"]), book


@query(f"WITH {_PACKED} SELECT doc_id, chunk_no, decision, CASE WHEN decision <> 'literal' THEN m.id ELSE -1 END AS id, md5(CASE WHEN decision = 'literal' THEN hex ELSE hex(xor(unhex(hex)::BIT, unhex(m.pattern)::BIT)::BLOB) END) AS stored_md5, md5(hex) AS rebuilt_md5 FROM k")
def codebook_pack(spark, sf_dir):
    """Each chunk as a pointer with a delta, or as it is; and rebuilt from what was stored and the codebook alone."""
    rows, book = packed(spark, sf_dir)
    stored = rows.select("doc_id", "chunk_no", "decision", "id", "stored")
    return codebook.rebuilt(stored, book).select("doc_id", "chunk_no", "decision", F.coalesce("id", F.lit(-1)).alias("id"), F.md5(F.hex("stored")).alias("stored_md5"), F.md5(F.hex("data")).alias("rebuilt_md5"))


@query(f"WITH {_PACKED} SELECT decision, count(*) AS chunks, round(avg(1 - m.distance / 1024), 6) AS similarity FROM k GROUP BY decision")
def codebook_exact_hit_rate(spark, sf_dir):
    """How often chunks are hits, deltas and literals, and how near their codewords are."""
    rows, _ = packed(spark, sf_dir)
    return rows.groupBy("decision").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(1 - F.col("distance") / 1024), 6).alias("similarity"))


@query(f"WITH {COUNTS}, {ELITE} SELECT count(*) AS patterns, sum(length(hex) // 2)::BIGINT AS n_bytes, sha256(string_agg(hex, '' ORDER BY id)) AS build FROM elite")
def codebook_identity(spark, sf_dir):
    """A codebook's build digest, over its patterns in order: peers compare it before they exchange pointers. At most 4096 patterns."""
    e = chunks.elite(chunk_counts(spark, sf_dir), 8, 4096).select("id", F.hex("data").alias("hex"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "hex"))), lambda x: x["hex"]), "")
    return e.agg(F.count(F.lit(1)).alias("patterns"), F.sum(F.length("hex") / 2).cast("long").alias("n_bytes"), F.sha2(joined.cast("binary"), 256).alias("build"))


_SPLIT = f"{fixed_sql(128)}, old AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 0 GROUP BY hex ORDER BY n DESC, hex LIMIT 512), new AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 1 GROUP BY hex)"


def old_and_new(spark, sf_dir):
    old = chunk_counts(spark, sf_dir, "doc_id % 2 = 0").orderBy(F.desc("n"), "data").limit(512)
    return old, chunk_counts(spark, sf_dir, "doc_id % 2 = 1")


@query(f"WITH {_SPLIT}, a AS (SELECT hex, n, 0 AS late FROM old UNION ALL SELECT hex, n, 1 FROM new WHERE hex NOT IN (SELECT hex FROM old)) SELECT row_number() OVER (ORDER BY late, n DESC, hex) - 1 AS place, late = 0 AS old, n, md5(hex) AS chunk_md5 FROM a QUALIFY place < 1024")
def codebook_priority_merge(spark, sf_dir):
    """The patterns of the older codebook first, then new ones it lacks, 1024 in all."""
    old, new = old_and_new(spark, sf_dir)
    return codebook.priority_merge(old, new, 1024).select("place", "old", "n", F.md5(F.hex("data")).alias("chunk_md5"))


@query(f"WITH {_SPLIT} SELECT (SELECT count(*) FROM old) AS old, (SELECT count(*) FROM new) AS new, (SELECT count(*) FROM new WHERE hex IN (SELECT hex FROM old)) AS shared, least((SELECT count(*) FROM new WHERE hex NOT IN (SELECT hex FROM old)), 512) AS replaced")
def codebook_overlap(spark, sf_dir):
    """Counters of the merge: patterns of each side, shared ones, and places that new ones take."""
    old, new = old_and_new(spark, sf_dir)
    both = old.select("data", F.lit(1).alias("a")).join(new.select("data", F.lit(1).alias("b")), "data", "full")
    fresh = F.count("b") - F.count(F.col("a") + F.col("b"))
    return both.agg(F.count("a").alias("old"), F.count("b").alias("new"), F.count(F.col("a") + F.col("b")).alias("shared"), F.least(fresh, F.lit(512)).alias("replaced"))


@query(f"""WITH {COUNTS}, top AS (SELECT hex, n FROM n ORDER BY n DESC, hex LIMIT 256), v AS (SELECT substr(hex, 3) || '00' AS hex, greatest(n // 2, 1) AS n FROM top WHERE n > 1 UNION ALL SELECT '00' || substr(hex, 1, length(hex) - 2), greatest(n // 2, 1) FROM top WHERE n > 1
UNION ALL SELECT substr(hex, 3) || substr(hex, 1, 2), greatest(n // 2, 1) FROM top WHERE n > 1 UNION ALL SELECT hex, n FROM top) SELECT md5(hex) AS chunk_md5, sum(n)::BIGINT AS n FROM v GROUP BY hex""")
def codebook_augment_top(spark, sf_dir):
    """Shifted and turned variants of the 256 commonest patterns."""
    return chunks.augmented(chunk_counts(spark, sf_dir).orderBy(F.desc("n"), "data").limit(256)).select(F.md5(F.hex("data")).alias("chunk_md5"), "n")


@query("""WITH t AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO [worker-' || user_id % 10 || '] Processed request ' || event_id || ' from 192.168.1.' || event_id % 255 || ' - STATUS ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS line, user_id % 10 AS worker FROM events)
SELECT worker, count(*) AS n, sum(length(line))::BIGINT AS chars, max(line) AS last FROM t GROUP BY worker""")
def log_lines(spark, sf_dir):
    """Events as the lines of a service's log, by worker."""
    e = table(spark, sf_dir, "events").withColumn("worker", F.col("user_id") % 10)
    status = F.when(F.col("event_type") == "error", "ERROR").otherwise("OK")
    line = F.format_string("%s INFO [worker-%d] Processed request %d from 192.168.1.%d - STATUS %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "worker", "event_id", F.col("event_id") % 255, status)
    return e.select("worker", line.alias("line")).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"), F.max("line").alias("last"))


_TRAIN = f"{fixed_sql(128)}, book AS (SELECT DISTINCT hex FROM c WHERE doc_id % 2 = 0 AND length(hex) = 256), cost AS (SELECT doc_id, count(*) AS n_chunks, count(book.hex) AS hits, sum(length(c.hex) // 2)::BIGINT AS raw, (24 * count(*) + coalesce(sum(CASE WHEN book.hex IS NULL THEN length(c.hex) // 2 END), 0))::BIGINT AS packed FROM c LEFT JOIN book USING (hex) WHERE doc_id % 2 = 1 GROUP BY doc_id)"


def costs(spark, sf_dir):
    raw = documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("raw"))
    return pack_cost(spark, sf_dir).select("doc_id", "n_chunks", "hits", F.col("packed_bytes").alias("packed")).join(raw, "doc_id")


@query(f"WITH {_TRAIN} SELECT CASE WHEN packed < 100 THEN 0 WHEN packed < 500 THEN 1 WHEN packed < 1000 THEN 2 WHEN packed < 5000 THEN 3 WHEN packed < 10000 THEN 4 WHEN packed < 30000 THEN 5 WHEN packed < 60000 THEN 6 ELSE 7 END::BIGINT AS bucket, count(*) AS documents, sum(raw - packed)::BIGINT AS saved, round(sum(raw) / sum(packed), 6) AS ratio, round(100 * (1 - sum(packed) / sum(raw)), 6) AS reduction FROM cost GROUP BY 1")
def pack_metrics(spark, sf_dir):
    """Bytes saved, ratio and reduction in percent, by size of what was packed."""
    bounds = [100, 500, 1000, 5000, 10000, 30000, 60000]
    bucket = sum(((F.col("packed") >= b).cast("long") for b in bounds[1:]), (F.col("packed") >= bounds[0]).cast("long"))
    return costs(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("raw") - F.col("packed")).alias("saved"), F.round(F.sum("raw") / F.sum("packed"), 6).alias("ratio"), F.round(100 * (1 - F.sum("packed") / F.sum("raw")), 6).alias("reduction"))


@query(f"WITH {_TRAIN} SELECT doc_id, raw <= 33554432 AND packed / raw <= 0.95 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS promoted FROM cost")
def promotion_gate(spark, sf_dir):
    """Documents that are trusted (labelled as good), small enough and packed to at most 0.95 of their size."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    rows = costs(spark, sf_dir).join(trusted, "doc_id", "left")
    return rows.select("doc_id", ((F.col("raw") <= 32 << 20) & (F.col("packed") / F.col("raw") <= 0.95) & F.coalesce("trusted", F.lit(False))).alias("promoted"))


@query(f"""WITH {fixed_sql(512)}, n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) SELECT c.doc_id, c.chunk_no AS idx FROM c JOIN n USING (doc_id) WHERE doc_id % 4 = 0 OR (doc_id % 4 = 1 AND chunk_no = 0 AND left(hex, 2) <> '23')
UNION ALL SELECT doc_id, n AS idx FROM n WHERE doc_id % 4 = 0""")
def merkle_diff(spark, sf_dir):
    """Leaves that differ between documents and a copy: every fourth has one leaf more, so all of its leaves count; of the next ones the first byte is changed."""
    c = chunks.fixed(documents(spark, sf_dir), "doc_id", "text", 512).select("doc_id", F.col("chunk_no").alias("idx"), "data")
    changed = (F.col("doc_id") % 4 == 1) & (F.col("idx") == 0)
    other = c.withColumn("data", F.when(changed, F.concat(F.lit(b"#"), F.substring("data", 2, 512))).otherwise(F.col("data")))
    last = c.filter("doc_id % 4 = 0").groupBy("doc_id").agg((F.max("idx") + 1).alias("idx")).withColumn("data", F.lit(b"more"))
    hashes = lambda rows: rows.select("doc_id", "idx", F.sha2("data", 256).alias("hash"))
    return chunks.leaf_diff(hashes(c), hashes(other.unionByName(last)), "doc_id")


@query()
def rabin_chunks(spark, sf_dir):
    """Chunks cut where the polynomial hash of the last eight bytes is a multiple of the target."""
    return bpe.content_chunks(documents(spark, sf_dir), "doc_id", "text", 512, bpe.rabin_cuts)


@query(f"SELECT item_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), (2 * i + 1)::INT, 2))::INT::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::VARCHAR AS digest FROM benchmark")
def fnv_digest(spark, sf_dir):
    """FNV-1a of each item's bytes, as an unsigned number."""
    return table(spark, sf_dir, "benchmark").select("item_id", content.fnv1a(F.col("text")).alias("digest"))


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE strlen(text) > 2), i AS (SELECT doc_id, ('0x' || substr(h, 1, 2))::BIGINT AS a, ('0x' || substr(h, 3, 2))::BIGINT AS b, ('0x' || substr(h, 5, 2))::BIGINT AS c FROM b)
SELECT doc_id, list_sum(list_transform(range(64), lambda x: (a * x * x + b * x + c) % 256))::BIGINT AS total, (a * 9 + b * 3 + c) % 256 AS fourth FROM i""")
def polynomial_bytes(spark, sf_dir):
    """The first bytes that a x^2 + b x + c mod 256 generates, with each document's first three bytes as its seed."""
    byte = lambda k: F.conv(F.substring(F.hex(F.encode("text", "UTF-8")), 2 * k + 1, 2), 16, 10).cast("long")
    seeds = documents(spark, sf_dir).filter(F.octet_length("text") > 2).select("doc_id", *(byte(k).alias(n) for k, n in enumerate("abc")))
    made = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: (F.col("a") * x * x + F.col("b") * x + F.col("c")) % 256)
    return seeds.select("doc_id", F.aggregate(made, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.get(made, F.lit(3)).alias("fourth"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS plain, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z0-9]+')) AS whole FROM documents)
SELECT doc_id, len(plain)::BIGINT AS n_plain, md5(array_to_string(plain, ' ')) AS plain_md5, len(whole)::BIGINT AS n_whole, md5(array_to_string(whole, ' ')) AS whole_md5 FROM w""")
def word_runs(spark, sf_dir):
    """Two more tokenizers: runs of ASCII word characters, and of a-z and 0-9 that stand alone between word breaks."""
    w = documents(spark, sf_dir).select("doc_id", text.plain_words(F.col("text")).alias("p"), text.whole_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("p").cast("long").alias("n_plain"), F.md5(F.array_join("p", " ")).alias("plain_md5"), F.size("w").cast("long").alias("n_whole"), F.md5(F.array_join("w", " ")).alias("whole_md5"))


@query(f"SELECT doc_id, printf('%05d: %s', doc_id, upper(substr({TOKENS}[1], 1, 1)) || substr({TOKENS}[1], 2)) AS line FROM documents WHERE len({TOKENS}) > 0")
def title_lines(spark, sf_dir):
    """A number and the first token with a capital, as a report prints them."""
    first = F.get(text.tokens(F.col("text")), F.lit(0))
    return documents(spark, sf_dir).select("doc_id", first.alias("w")).filter("w IS NOT NULL").select("doc_id", F.format_string("%05d: %s", F.col("doc_id"), F.initcap("w")).alias("line"))


@query("SELECT doc_id, md5(strip_accents(text)) AS folded_md5 FROM documents")
def accent_fold(spark, sf_dir):
    """Texts without their accents: letters are taken apart, marks dropped, the rest composed."""
    return documents(spark, sf_dir).select("doc_id", F.md5(text.unaccented(F.col("text"))).alias("folded_md5"))


_ALLOWED = f"{COUNTS}, {ELITE}, q AS (SELECT doc_id, chunk_no, hex FROM c WHERE doc_id % 100 = 0 AND length(hex) = 256), d AS (SELECT doc_id, chunk_no, b.id, bit_count(xor(unhex(q.hex)::BIT, unhex(b.hex)::BIT))::BIGINT AS distance FROM q, elite b WHERE b.id % 5 IN (1, 3))"


@query(f"WITH {_ALLOWED} SELECT doc_id, chunk_no, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM d GROUP BY doc_id, chunk_no")
def codeword_allowed(spark, sf_dir):
    """The nearest codeword of each chunk of the stated documents among a list of allowed ids."""
    c = chunks.fixed(documents(spark, sf_dir).filter("doc_id % 100 = 0"), "doc_id", "text", 128).filter(F.length("data") == 128)
    book = chunks.elite(chunk_counts(spark, sf_dir), 8, 4096).select("id", "data")
    allowed = book.filter((F.col("id") % 5).isin(1, 3)).select("id")
    return codebook.nearest_linear(c.select("doc_id", "chunk_no", "data"), book.join(F.broadcast(allowed), "id", "left_semi"), ["doc_id", "chunk_no"])


_SECRET = b"a secret of the peers"
_PADS = ["".join(f"{b ^ pad:02X}" for b in _SECRET.ljust(64, b"\0")) for pad in (0x36, 0x5C)]
_MESSAGE = "hex(encode(event_id || ':' || user_id))"


def _hmac(message: str) -> str:
    return f"sha256(unhex('{_PADS[1]}' || sha256(unhex('{_PADS[0]}' || {message}))))"


@query(f"""WITH m AS (SELECT event_id, user_id % 7 AS peer, substr(md5(event_type), 1, 1) AS topic, value, {_hmac(_MESSAGE)} AS good, CASE WHEN event_id % 4 = 0 THEN {_hmac("hex(encode(event_id || ':' || (user_id + 1)))")} ELSE {_hmac(_MESSAGE)} END AS signature FROM events)
SELECT event_id, peer, topic, signature FROM m WHERE peer <> 3 AND topic IN ('3', '6', 'b', 'c') AND (value <= 0 OR signature = good)""")
def gossip_accept(spark, sf_dir):
    """Messages of the topics subscribed to that others sent; those with weight need the peers' HMAC, and every fourth message has that of another sender."""
    message = lambda who: F.encode(F.concat_ws(":", F.col("event_id").cast("string"), who.cast("string")), "UTF-8")
    signed = lambda who: F.lower(F.hex(codebook.hmac_sha256(_SECRET, message(who))))
    sender = F.when(F.col("event_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 7).alias("peer"), F.substring(F.md5("event_type"), 1, 1).alias("topic"), F.col("value").alias("weight"), signed(sender).alias("signature"))
    return content.accepted(rows, 3, ["3", "6", "b", "c"], F.col("signature") == signed(F.col("user_id"))).select("event_id", "peer", "topic", "signature")


#: First bytes of a picture of two kinds.
_PNG, _WEBP = "89504E470D0A1A0A", "524946460102030457454250"
_CASCADE = f"""{COUNTS}, {ELITE}, p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '{_PNG}' WHEN 3 THEN '{_WEBP}' END || hex(encode(text)) AS t, upper(array_to_string(list_transform(range(64), lambda i: md5(doc_id || ':' || i)), '')) AS noise FROM documents),
y AS (SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN noise ELSE t END AS hex FROM p),
z AS (SELECT doc_id, k AS chunk_no, left(y.hex, 24) AS head, substr(y.hex, (256 * k + 1)::INT, 256) AS hex FROM y, LATERAL unnest(range(length(y.hex) // 256)) t(k)),
bc AS (SELECT doc_id, chunk_no, b, count(*) AS c FROM (SELECT doc_id, chunk_no, unnest(list_transform(range(128), lambda i: substr(hex, (2 * i + 1)::INT, 2))) AS b FROM z) GROUP BY ALL),
e AS (SELECT doc_id, chunk_no, -sum(c / 128 * log2(c / 128)) AS e FROM bc GROUP BY ALL),
g AS (SELECT z.*, CASE WHEN starts_with(head, left('{_PNG}', 8)) OR regexp_matches(head, '^52494646.{{8}}57454250') THEN 'packed' WHEN e > 5.5 THEN 'noise' END AS gate FROM z JOIN e USING (doc_id, chunk_no)),
d AS (SELECT g.doc_id, g.chunk_no, g.hex, min(struct_pack(distance := bit_count(xor(unhex(g.hex)::BIT, unhex(x.hex)::BIT))::BIGINT, id := x.id, pattern := x.hex)) AS m FROM g LEFT JOIN elite x ON substr(g.hex, 1, 4) = substr(x.hex, 1, 4) WHERE gate IS NULL GROUP BY ALL),
k AS (SELECT doc_id, chunk_no, CASE WHEN m.id IS NULL OR 1 - m.distance / 1024 <= 0.2 THEN 'literal' WHEN 1 - m.distance / 1024 > 0.95 THEN 'hit' ELSE 'delta' END AS decision, m.distance AS distance FROM d
UNION ALL SELECT doc_id, chunk_no, gate, NULL FROM g WHERE gate IS NOT NULL)"""


@query(f"WITH {_CASCADE} SELECT doc_id % 4 AS kind, decision, count(*) AS chunks, count(*) FILTER (decision NOT IN ('packed', 'noise')) AS searched, sum(distance)::BIGINT AS distance FROM k GROUP BY ALL")
def search_cascade(spark, sf_dir):
    """Texts, the same behind the first bytes of two kinds of pictures, and digests: how many chunks each gate takes before the search."""
    docs, kind = documents(spark, sf_dir), F.col("doc_id") % 4
    noise = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), i.cast("string")))), ""))
    start = F.when(kind == 1, F.unhex(F.lit(_PNG))).when(kind == 3, F.unhex(F.lit(_WEBP))).otherwise(F.lit(b""))
    payload = docs.select("doc_id", F.when(kind == 2, noise).otherwise(F.concat(start, F.encode("text", "UTF-8"))).alias("data"))
    parts = chunks.slices(F.decode("data", "ISO-8859-1"), 128)
    rows = payload.select("doc_id", F.substring("data", 1, 12).alias("head"), F.posexplode(parts).alias("chunk_no", "_c")).select("doc_id", "chunk_no", "head", F.encode("_c", "ISO-8859-1").alias("data"))
    book = chunks.elite(chunk_counts(spark, sf_dir), 8, 4096).select("id", "data")
    found = cascade.decided(rows.filter(F.length("data") == 128), book, ["doc_id", "chunk_no"], noisy=5.5)
    looked = F.count_if(~F.col("decision").isin("packed", "noise"))
    return found.groupBy((F.col("doc_id") % 4).alias("kind"), "decision").agg(F.count(F.lit(1)).alias("chunks"), looked.alias("searched"), F.sum("distance").alias("distance"))


#: A registry of codebooks: name, category, hint, bytes of a codeword. The second size has no universal one.
_REGISTRY = [("logs-128", "text_logs", "text", 128), ("packed-128", "compressed", "zip", 128), ("pdf-128", "document", "pdf", 128), ("odd-128", "other", "unknown", 128), ("plain-128", "universal", "", 128), ("picture-64", "raw_image", "bmp", 64), ("elf-64", "machine", "elf", 64)]
_VALUES = ", ".join(f"('{b}', '{c}', '{h}', {n})" for b, c, h, n in _REGISTRY)


@query(f"""WITH books(book, category, hint, size) AS (VALUES {_VALUES}), k AS ({SQL["content_kinds"]}), a AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 64 ELSE 128 END AS size, CASE WHEN confidence >= 0.5 THEN category END AS sure FROM k)
SELECT doc_id, category, hint, confidence, coalesce((SELECT min(book) FROM books b WHERE b.size = a.size AND b.category = a.sure), (SELECT min(book) FROM books b WHERE b.size = a.size AND b.hint = a.hint),
(SELECT min(book) FROM books b WHERE b.size = a.size AND b.category = 'universal'), (SELECT min(book) FROM books b WHERE b.size = a.size)) AS book FROM a""")
def content_route(spark, sf_dir):
    """The codebook of each content by what it looks like: by category where that is sure, else by hint, else the universal one, else any of the size."""
    start = F.element_at(F.array(*(F.lit(x) for x in _STARTS)), (F.col("doc_id") % 12 + 1).cast("int"))
    data = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 5 == 0, 64).otherwise(128).cast("long").alias("size"), F.concat(F.unhex(start), F.encode("text", "UTF-8")).alias("data"))
    books = spark.createDataFrame(_REGISTRY, "book string, category string, hint string, size long")
    return cascade.routed(data, books).select("doc_id", "category", "hint", "confidence", "book")
