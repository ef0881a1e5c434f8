"""Queries over conversations in order, retrieval branches, scores fed by feedback, and searches on flipped hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hashloom.functions import bits, calibration, text
from hashloom.operators import dialogue, lexicon, search
from hashloom.operators.hashing import token_simhash

from .sqltext import HASHES, NEAREST, PAIRS, TOKENS, bags, dist, mask, token_hash
from .texts import _TURNS, _idf, _terms, qa_retrieval, table, turn_hashes, turns
from .vectors import asked, hashed

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_ORDERED = "o AS MATERIALIZED (SELECT msg // 1000 AS conv_id, msg % 1000 AS turn, hash, lag(hash) OVER (PARTITION BY msg // 1000 ORDER BY msg) AS before, row_number() OVER (PARTITION BY msg // 1000 ORDER BY msg) AS k FROM hashes)"


def fold_sql(hash_sql: str) -> str:
    """The semantic cache as a recursive query: step k takes the k-th turn of every conversation."""
    return f"""WITH RECURSIVE {_TURNS}, {_ORDERED}, p AS MATERIALIZED (SELECT conv_id, turn, k, {hash_sql} AS hash FROM o),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, []::STRUCT(turn BIGINT, hash BIGINT)[] AS held, NULL::BIGINT AS turn, NULL::STRUCT(turn BIGINT, hash BIGINT) AS m, NULL::BIGINT AS hash FROM p
UNION ALL SELECT conv_id, k, CASE WHEN m IS NULL THEN list_append(held, {{'turn': turn, 'hash': hash}}) ELSE held END, turn, m, hash FROM (
SELECT p.conv_id, p.k, f.held, p.turn, p.hash, list_filter(f.held, lambda x: bit_count(xor(x.hash, p.hash)) <= 20)[1] AS m FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1))
SELECT conv_id, turn, CASE WHEN m IS NULL THEN 'insert' ELSE 'hit' END AS action, m.turn AS match_turn, bit_count(xor(m.hash, hash))::BIGINT AS distance FROM f WHERE k > 0"""


def ordered(spark, sf_dir):
    """(conv_id, turn, hash, before): each turn's hash and that of the turn before it that has one."""
    h = turn_hashes(spark, sf_dir).select("at.conv_id", "at.turn", "hash")
    earlier = h.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("hash").alias("before"))
    return h.join(earlier, ["conv_id", "turn"], "left")


@query(fold_sql("hash"))
def semantic_cache_fold(spark, sf_dir):
    """Each turn reuses the first stored hash of its conversation within 20 bits, or stores its own."""
    return dialogue.cache_fold(ordered(spark, sf_dir).select("conv_id", "turn", "hash"), 20)


_DECAYED = f"before & ~{mask('conv_id || chr(58) || turn', '2')}"


@query(fold_sql(f"CASE WHEN before IS NULL OR ({_DECAYED}) = 0 THEN hash ELSE (({_DECAYED}) & -4294967296) | (hash & 4294967295) END"))
def decayed_context_fold(spark, sf_dir):
    """The cache over hashes whose high half is the turn before's, an eighth of its bits lost."""
    key = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    rows = ordered(spark, sf_dir).withColumn("before", F.coalesce(bits.cleared(F.col("before"), bits.bernoulli_mask(key, F.lit(2))), F.lit(0)))
    return dialogue.cache_fold(rows.select("conv_id", "turn", bits.mix_context(F.col("before"), F.col("hash")).alias("hash")), 20)


@query(f"""WITH RECURSIVE {_TURNS}, {_ORDERED}, p AS MATERIALIZED (SELECT conv_id, turn, k, hash AS raw, CASE WHEN before IS NULL OR before = 0 THEN hash ELSE (before & -4294967296) | (hash & 4294967295) END AS mixed FROM o),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, []::BIGINT[] AS held, NULL::BIGINT AS turn, NULL::VARCHAR AS action, NULL::BIGINT AS distance FROM p
UNION ALL SELECT conv_id, k, CASE action WHEN 'insert' THEN list_append(held, mixed) WHEN 'reset' THEN list_append(held, raw) ELSE held END, turn, action, coalesce(distance, -1) FROM (
SELECT *, CASE WHEN distance IS NULL THEN 'insert' WHEN distance <= 14 AND 100 / (1 + exp(1.5 * (distance - 12))) > 60 THEN 'hit' ELSE 'reset' END AS action FROM (
SELECT p.conv_id, p.k, f.held, p.turn, p.raw, p.mixed, bit_count(xor(list_filter(f.held, lambda x: bit_count(xor(x, p.mixed)) <= 20)[1], p.mixed))::BIGINT AS distance FROM f JOIN p ON p.conv_id = f.conv_id AND p.k = f.k + 1)))
SELECT conv_id, turn, action, distance FROM f WHERE k > 0""")
def context_reset_fold(spark, sf_dir):
    """The cache with the context of the turn before, a gate on confidence, and a reset where it is low."""
    rows = ordered(spark, sf_dir)
    return dialogue.reset_fold(rows.select("conv_id", "turn", F.col("hash").alias("raw"), bits.mix_context(F.coalesce("before", F.lit(0)), F.col("hash")).alias("mixed")), 20, 12.0)


@query(f"WITH first AS (SELECT conv_id, text FROM conversations WHERE role = 'user' AND turn = 0), {bags('first', 'conv_id')} SELECT token, round(sum(tf) / (SELECT count(*) FROM first), 6) AS mean FROM terms GROUP BY token")
def greeting_centroid(spark, sf_dir):
    """The mean count of each token over first turns; a token that a turn lacks counts 0 there."""
    first = table(spark, sf_dir, "conversations").filter("role = 'user' AND turn = 0")
    n = first.agg(F.count(F.lit(1)).alias("_n"))
    sums = lexicon.term_counts(first, "conv_id", "text").groupBy("token").agg(F.sum("tf").alias("tf"))
    return sums.crossJoin(F.broadcast(n)).select("token", F.round(F.col("tf") / F.col("_n"), 6).alias("mean"))


@query(f"""WITH {_TURNS}, first AS (SELECT 0 AS one, text FROM conversations WHERE role = 'user' AND turn = 0), {bags('first', 'one').replace('terms AS', 'bag AS')}, {token_hash('bag', 'one', 'tf', 'centre')}
SELECT t.conv_id, t.turn, {dist('h.hash', 'c.hash')} AS distance, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 12 AND {dist('h.hash', 'c.hash')} <= 26 AS anchored,
CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) <= 12 AND {dist('h.hash', 'c.hash')} <= 26 THEN 99.0 ELSE round(100 / (1 + exp(1.5 * ({dist('h.hash', 'c.hash')} - 16))), 6) END AS confidence
FROM talk t JOIN hashes h USING (msg), centre c WHERE role = 'user'""")
def centroid_anchor(spark, sf_dir):
    """User turns of 12 words at most within 26 bits of the greetings' centroid take the stock answer at 99 percent."""
    first = table(spark, sf_dir, "conversations").filter("role = 'user' AND turn = 0")
    sums = lexicon.term_counts(first, "conv_id", "text").groupBy("token").agg(F.sum("tf").alias("tf"))
    centre = token_simhash(sums.withColumn("one", F.lit(0)), "one", "token", "tf")
    rows = turns(spark, sf_dir).filter("role = 'user'").join(turn_hashes(spark, sf_dir).select("at", "hash"), "at")
    near = dialogue.anchored(rows, centre, text.word_count(F.col("text")), 12, 26)
    score = F.when(F.col("anchored"), F.lit(99.0)).otherwise(F.round(calibration.confidence(F.col("distance"), 16.0), 6))
    return near.select("conv_id", "turn", "distance", "anchored", score.alias("confidence"))


@query(f"""WITH {bags('documents', 'doc_id')}, df AS (SELECT token, count(*) AS df FROM terms GROUP BY token), v AS (SELECT token FROM df ORDER BY df DESC, token LIMIT 256),
asked AS (SELECT conv_id, turn, unnest(CASE WHEN len({TOKENS}) = 0 THEN [NULL] ELSE list_distinct({TOKENS}) END) AS token FROM conversations WHERE role = 'user')
SELECT conv_id, turn, count(v.token) AS mapped, count(v.token) = 0 AS rejected FROM asked LEFT JOIN v USING (token) GROUP BY conv_id, turn""")
def mapped_gate(spark, sf_dir):
    """User turns none of whose tokens are among the 256 commonest of the documents are turned away."""
    df = _terms(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    known = df.orderBy(F.desc("df"), "token").limit(256).select("token", F.lit(1).alias("known"))
    t = table(spark, sf_dir, "conversations").filter("role = 'user'")
    rows = t.select("conv_id", "turn", F.explode_outer(F.array_distinct(text.tokens(F.col("text")))).alias("token")).join(F.broadcast(known), "token", "left")
    return rows.groupBy("conv_id", "turn").agg(F.count("known").alias("mapped")).withColumn("rejected", F.col("mapped") == 0)


_QA = f"""WITH {_TURNS}, n AS (SELECT msg, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM talk),
asked AS (SELECT t.msg, hash FROM talk t JOIN hashes h USING (msg) WHERE role = 'user'),
near AS (SELECT q.msg AS query, arg_min(r.msg, ({dist('q.hash', 'r.hash')}, r.msg)) AS id, min({dist('q.hash', 'r.hash')}) AS distance FROM asked q, asked r WHERE q.msg // 1000 % 100 = 0 AND q.msg <> r.msg GROUP BY q.msg)"""


@query(f"""{_QA} SELECT query, id, CASE WHEN 100 / (1 + exp(distance - (12 + 6 / log2(greatest(words, 1) + 1)))) > 70 THEN 'retrieve' ELSE 'generate' END AS branch, md5(a.text) AS answer_md5
FROM near JOIN n ON n.msg = query LEFT JOIN talk a ON a.msg = id + 1""")
def retrieve_or_generate(spark, sf_dir):
    """The branch each stated query takes, and the answer that followed the turn it found."""
    answers = turns(spark, sf_dir).select((F.col("msg") - 1).alias("id"), F.md5("text").alias("answer_md5"), "turn").filter("turn > 0").drop("turn")
    found = qa_retrieval(spark, sf_dir)
    return found.join(answers, "id", "left").select("query", "id", F.when(F.col("confidence") > 70, "retrieve").otherwise("generate").alias("branch"), "answer_md5")


_MIDDLE = "middles AS (SELECT user_id, greatest(1, 4 * power(0.85, count(*) FILTER (event_type = 'error'))) AS middle FROM events GROUP BY user_id)"
_DYNAMIC = "CASE WHEN distance > ceil(3 * coalesce(middle, 4.0)) THEN 0.0 ELSE 100 / (1 + exp(1.5 * (distance - coalesce(middle, 4.0)))) END"


@query(f"WITH {HASHES}, {PAIRS}, {_MIDDLE} SELECT distance, coalesce(round(middle, 6), 4.0) AS middle, round({_DYNAMIC}, 6) AS score, count(*) AS pairs FROM pairs LEFT JOIN middles ON user_id = id % 97 WHERE distance <= 20 GROUP BY ALL")
def dynamic_score(spark, sf_dir):
    """Scores of near pairs under the middles that feedback has left: what was punished needs nearer matches."""
    q, r = asked(spark, sf_dir)
    d = bits.hamming(F.col("hash"), F.col("qhash"))
    near = search.against_all(q, r).filter("id <> query").withColumn("distance", d).filter("distance <= 20").withColumn("user_id", F.col("id") % 97)
    n = F.count_if(F.col("event_type") == "error")
    middles = table(spark, sf_dir, "events").groupBy("user_id").agg(calibration.punished(n).alias("middle"))
    rows = near.join(middles, "user_id", "left").withColumn("middle", F.coalesce("middle", F.lit(4.0)))
    return rows.select("distance", F.round("middle", 6).alias("middle"), F.round(calibration.dynamic(F.col("distance"), F.col("middle")), 6).alias("score")).groupBy("distance", "middle", "score").agg(F.count(F.lit(1)).alias("pairs"))


_REPORT = f"""report AS (SELECT query AS id, CASE query // 100 % 4 WHEN 0 THEN 'Hard Negative' WHEN 1 THEN 'rotacao' WHEN 2 THEN 'salt_pepper' ELSE 'oclusao' END || ' ' || query AS description, distance,
round(CASE WHEN distance > 14 THEN 0.0 ELSE 100 / (1 + exp(1.5 * (distance - 4))) END, 6) AS confidence FROM near)"""
_KIND = "CASE WHEN contains(description, 'Hard Negative') THEN 'negative' WHEN regexp_matches(description, 'rotacao|salt_pepper|oclusao') THEN 'image' ELSE 'text' END AS kind"


def report(spark, sf_dir):
    found = search.nearest(*asked(spark, sf_dir))
    names = F.element_at(F.array(*map(F.lit, ["Hard Negative", "rotacao", "salt_pepper", "oclusao"])), (F.expr("query DIV 100") % 4 + 1).cast("int"))
    rows = found.select(F.col("query").alias("id"), F.concat(names, F.lit(" "), F.col("query").cast("string")).alias("description"), "distance", F.round(calibration.hard_negative(F.col("distance"), 14), 6).alias("confidence"))
    return rows.withColumn("kind", F.when(F.contains("description", F.lit("Hard Negative")), "negative").when(F.col("description").rlike("rotacao|salt_pepper|oclusao"), "image").otherwise("text"))


@query(f"WITH {HASHES}, {PAIRS}, {NEAREST}, {_REPORT} SELECT id, description, {_KIND}, distance, confidence, CASE WHEN (confidence < 50) = contains(description, 'Hard Negative') THEN 'pass' ELSE 'fail' END AS status FROM report")
def gauntlet_report(spark, sf_dir):
    """The stated queries as test rows: kind by what the description says, and whether the confidence is as it should be."""
    rows = report(spark, sf_dir)
    return rows.withColumn("status", F.when((F.col("confidence") < 50) == (F.col("kind") == "negative"), "pass").otherwise("fail"))


@query(f"WITH {HASHES}, {PAIRS}, {NEAREST}, {_REPORT} SELECT count(*) FILTER (confidence >= 50) AS accepted, count(*) FILTER (distance > 14) AS rejected_early, round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.99), 6) AS p99 FROM report")
def gauntlet_summary(spark, sf_dir):
    """Counters and percentiles over the report."""
    d = F.col("distance")
    return report(spark, sf_dir).agg(F.count_if(F.col("confidence") >= 50).alias("accepted"), F.count_if(d > 14).alias("rejected_early"), F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, 0.5), 6).alias("p50"), F.round(F.percentile(d, 0.99), 6).alias("p99"))


#: Copies of each hash, with a bit flipped for each of the three places that a copy's number names.
_COPIES = 32
_FLIPS = "xor(xor(h, 1::BIGINT << ((copy * 7 + vec_id) % 61)::INT), xor(1::BIGINT << ((copy * 11 + vec_id) % 59)::INT, 1::BIGINT << ((copy * 13 + 5 + vec_id) % 53)::INT))"
_FLIPPED = f"flipped AS (SELECT vec_id * {_COPIES} + copy AS id, {_FLIPS} AS h FROM one, range({_COPIES}) c(copy))"
_NEAR_FLIPPED = "shared AS (SELECT q.vec_id AS query, r.id, bit_count(xor(q.h, r.h))::BIGINT AS distance, min(b) AS band FROM one q, flipped r, range(4) t(b) WHERE q.vec_id % 100 = 0 AND ((q.h >> (48 - 16 * b)::INT) & 65535) = ((r.h >> (48 - 16 * b)::INT) & 65535) GROUP BY ALL)"


def flipped(spark, sf_dir):
    bit = lambda k, m: F.call_function("shiftleft", F.lit(1).cast("long"), ((F.col("copy") * k[0] + k[1] + F.col("vec_id")) % m).cast("int"))
    rows = hashed(spark, sf_dir).select("vec_id", "h", F.explode(F.sequence(F.lit(0), F.lit(_COPIES - 1))).alias("copy"))
    changed = F.col("h").bitwiseXOR(bit((7, 0), 61)).bitwiseXOR(bit((11, 0), 59)).bitwiseXOR(bit((13, 5), 53))
    return rows.select((F.col("vec_id") * _COPIES + F.col("copy")).alias("id"), changed.alias("hash"))


@query(f"WITH {HASHES}, {_FLIPPED}, {_NEAR_FLIPPED} SELECT query, id, band, distance FROM shared WHERE query <> id")
def mih_flipped_candidates(spark, sf_dir):
    """Rows that share a band with a stated query, among copies with up to three bits flipped: each copy is sure to be met."""
    q, _ = asked(spark, sf_dir)
    return search.band_candidates(q, flipped(spark, sf_dir)).select("query", "id", "band", "distance")


@query(f"WITH {HASHES}, {_FLIPPED}, {_NEAR_FLIPPED} SELECT query, arg_min(id, (band, id)) AS id, arg_min(distance, (band, id)) AS distance, min(band) AS band FROM shared WHERE distance <= 3 AND query <> id GROUP BY query")
def mih_flipped_first(spark, sf_dir):
    q, _ = asked(spark, sf_dir)
    return search.band_first(q, flipped(spark, sf_dir), 3)


@query(f"WITH {HASHES}, {_FLIPPED} SELECT q.vec_id AS query, r.id, bit_count(xor(q.h, r.h))::BIGINT AS distance FROM one q, flipped r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.id AND bit_count(xor(q.h, r.h)) <= 3")
def exact_flipped(spark, sf_dir):
    """All copies within three bits of a stated query: what the band search must find of them."""
    q, _ = asked(spark, sf_dir)
    pairs = search.against_all(q, flipped(spark, sf_dir)).filter((F.col("id") != F.col("query")) & bits.within(F.col("hash"), F.col("qhash"), 3))
    return pairs.select("query", "id", bits.hamming(F.col("hash"), F.col("qhash")).alias("distance"))


@query(f"WITH {HASHES} SELECT vec_id, xor(e, {mask('vec_id::VARCHAR', '2')}) AS entity, xor(c, {mask('vec_id::VARCHAR', '4')}) AS context, xor(v, {mask('vec_id::VARCHAR', '6')}) AS visual FROM three")
def weighted_decay(spark, sf_dir):
    """A rate of 4 sixteenths: halved by relevance for the entity head, which has no anchor, once for context, 1.5 times for the visual one."""
    key = F.col("vec_id").cast("string")
    return hashed(spark, sf_dir, 3).select("vec_id", *(bits.flipped(F.col(c), bits.bernoulli_mask(key, F.lit(n))).alias(name) for c, n, name in (("h", 2, "entity"), ("c", 4, "context"), ("v", 6, "visual"))))


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b AS (SELECT v.vec_id, v.e, w.e AS o FROM v JOIN v w ON w.vec_id = v.vec_id - v.vec_id % 2 + 1 - v.vec_id % 2)
SELECT vec_id, round(list_sum(list_transform(range(1, 49), lambda i: e[i] * o[i])), 5) AS product, round(list_sum(list_transform(range(1, 65), lambda i: 0.6 * e[i] + 0.4 * o[i])), 5) AS mixed,
round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i <= 9 THEN -e[i] ELSE e[i] END)), 5) AS turned, round(list_sum(list_transform(e, lambda x: least(greatest(x, -0.1), 0.1))), 5) AS clipped FROM b""")
def vector_mixes(spark, sf_dir):
    """Each vector with its neighbour: product over the first 48 places, 0.6 to 0.4 mix, the first 15 percent of signs turned, values clipped."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    other = v.select((F.col("vec_id") - F.col("vec_id") % 2 + 1 - F.col("vec_id") % 2).alias("vec_id"), F.col("e").alias("o"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    short = F.zip_with(F.slice("e", 1, 48), F.slice("o", 1, 48), lambda x, y: x * y)
    turned = F.transform("e", lambda x, i: F.when(i < 9, -x).otherwise(x))
    return v.join(other, "vec_id").select("vec_id", total(short).alias("product"), total(F.zip_with("e", "o", lambda x, y: 0.6 * x + 0.4 * y)).alias("mixed"), total(turned).alias("turned"), total(F.transform("e", lambda x: F.least(F.greatest(x, F.lit(-0.1)), F.lit(0.1)))).alias("clipped"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT v.vec_id, c.vec_id AS code, round(list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))), 5) AS error FROM v, v c WHERE c.vec_id < 16)
SELECT vec_id, arg_min(code, (error, code)) AS code, min(error) AS error FROM d GROUP BY vec_id""")
def vq_rows(spark, sf_dir):
    """Each vector as the index of the nearest of 16 code rows, and the squared error of looking it up again."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    codes = F.broadcast(v.filter("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("e").alias("c")))  # 16 rows
    error = F.round(F.aggregate(F.zip_with("e", "c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x), 5)
    return v.crossJoin(codes).select("vec_id", F.struct(error.alias("error"), "code").alias("m")).groupBy("vec_id").agg(F.min("m").alias("m")).select("vec_id", "m.code", "m.error")


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS w, instr('0123456789abcdef', substr(md5(conv_id || ':' || turn), 1, 1)) - 1 AS rate FROM conversations),
m AS (SELECT conv_id, turn, rate, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN instr('0123456789abcdef', substr(md5(conv_id || ':' || turn || ':' || i), 1, 1)) - 1 < rate THEN '[MASK]' ELSE w[i] END) AS m FROM t)
SELECT conv_id, turn, rate::BIGINT AS sixteenths, len(list_filter(m, lambda x: x = '[MASK]'))::BIGINT AS masked, md5(array_to_string(m, ' ')) AS masked_md5 FROM m""")
def random_masking(spark, sf_dir):
    """A share of each turn's tokens masked, the share drawn for each turn; drawn from digests, so that runs agree."""
    nibble = lambda x: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(x), 1, 1)) - 1
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("w"), key.alias("key"), nibble(key).alias("rate"))
    m = t.withColumn("m", F.transform("w", lambda x, i: F.when(nibble(F.concat(F.col("key"), F.lit(":"), (i + 1).cast("string"))) < F.col("rate"), "[MASK]").otherwise(x)))
    return m.select("conv_id", "turn", F.col("rate").cast("long").alias("sixteenths"), F.size(F.filter("m", lambda x: x == "[MASK]")).cast("long").alias("masked"), F.md5(F.array_join("m", " ")).alias("masked_md5"))


@query(f"""WITH q AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS a FROM conversations), p AS (SELECT x.conv_id, x.turn, x.a, y.a AS b FROM q x JOIN q y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)
SELECT conv_id, turn, CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS overlap FROM p""")
def word_overlap(spark, sf_dir):
    """Jaccard of the words of each turn and the next."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(text.tokens(F.col("text"))).alias("a"))
    after = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    union = F.size(F.array_union("a", "b"))
    return w.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.when(union == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("a", "b")) / union, 6)).alias("overlap"))


@query("""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), v AS (SELECT conv_id, turn, 0 AS variant, text FROM q UNION ALL SELECT conv_id, turn, s, text || x FROM q, (VALUES (1, ' please'), (2, ' now')) t(s, x))
SELECT conv_id, turn, variant::BIGINT AS variant, copy AS copy, md5(text) AS text_md5 FROM v, range(1, 6) r(copy)""")
def suffix_variants(spark, sf_dir):
    """Each user turn as it is and with two endings, five times each."""
    endings = F.array(F.struct(F.lit(0).alias("variant"), F.lit("").alias("x")), F.struct(F.lit(1).alias("variant"), F.lit(" please").alias("x")), F.struct(F.lit(2).alias("variant"), F.lit(" now").alias("x")))
    q = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text", F.inline(endings))
    return q.select("conv_id", "turn", F.col("variant").cast("long").alias("variant"), F.explode(F.sequence(F.lit(1), F.lit(5)).cast("array<bigint>")).alias("copy"), F.md5(F.concat("text", "x")).alias("text_md5"))


@query(f"""WITH {bags('documents', 'doc_id')}, n AS (SELECT token, sum(tf) AS n FROM terms GROUP BY token), top AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS r FROM n QUALIFY r <= 8),
p AS (SELECT token, r, sum(n) OVER (ORDER BY r) AS upto, sum(n) OVER () AS total FROM top) SELECT d AS draw, arg_min(token, r) AS token FROM range(20) s(d), p WHERE upto * 20 > d * total GROUP BY d""")
def topk_draw(spark, sf_dir):
    """Twenty even draws from the eight likeliest tokens, by the inverse of their running sum."""
    top = _terms(spark, sf_dir).groupBy("token").agg(F.sum("tf").alias("n")).orderBy(F.desc("n"), "token").limit(8)
    held = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "token", "n")))  # of eight rows
    rows = top.agg(held.alias("t"), F.sum("n").alias("total")).crossJoin(spark.range(20).withColumnRenamed("id", "draw"))
    upto = lambda i: F.aggregate(F.slice("t", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    hit = F.filter(F.transform("t", lambda x, i: F.struct(upto(i).alias("upto"), x["token"].alias("token"))), lambda x: x["upto"] * 20 > F.col("draw") * F.col("total"))
    return rows.select("draw", F.get(hit, F.lit(0))["token"].alias("token"))


@query(f"""WITH {bags('documents', 'doc_id')}, idf AS (SELECT token, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM terms GROUP BY token),
{bags('benchmark', 'item_id').replace('terms AS', 'probe AS')}, {bags('conversations', 'conv_id').replace('terms AS', 'talk AS')}, spoken AS (SELECT DISTINCT token FROM talk JOIN idf USING (token)),
lost AS (SELECT DISTINCT token FROM probe WHERE length(token) > 2 AND token NOT IN (SELECT token FROM spoken)),
cut AS (SELECT token, unnest(list_prepend(token, list_transform(range(1, length(token) + 1), lambda i: substr(token, 1, (i - 1)::INT) || substr(token, (i + 1)::INT)))) AS v FROM (SELECT token FROM lost UNION SELECT token FROM spoken)),
found AS (SELECT l.token, min(s.token) AS match FROM (SELECT DISTINCT * FROM cut SEMI JOIN lost USING (token)) l JOIN (SELECT DISTINCT * FROM cut SEMI JOIN spoken USING (token)) s USING (v) WHERE levenshtein(l.token, s.token) <= 1 GROUP BY l.token)
SELECT item_id, token, round(tf * (CASE WHEN s.token IS NOT NULL THEN i.idf ELSE 0.5 * j.idf END), 6) AS weight FROM probe LEFT JOIN spoken s USING (token) LEFT JOIN idf i USING (token) LEFT JOIN found f USING (token) LEFT JOIN idf j ON j.token = f.match WHERE s.token IS NOT NULL OR f.match IS NOT NULL""")
def rescued_weights(spark, sf_dir):
    """Weights of the benchmark's tokens over the conversations' vocabulary: an unknown token within one edit of a known one counts half of it."""
    idf = _idf(spark, sf_dir, _terms(spark, sf_dir)).select("token", "idf")
    spoken = lexicon.term_counts(table(spark, sf_dir, "conversations"), "conv_id", "text").select("token").distinct().join(idf, "token")
    probe = lexicon.term_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = lexicon.rescue(probe.select("token").distinct().join(spoken, "token", "left_anti"), spoken.select("token"))
    half = found.join(spoken.select(F.col("token").alias("match"), F.col("idf")), "match").select("token", (0.5 * F.col("idf")).alias("idf"))
    return probe.join(spoken.unionByName(half), "token").select("item_id", "token", F.round(F.col("tf") * F.col("idf"), 6).alias("weight"))
