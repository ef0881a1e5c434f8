"""What a cut, a small table or a narrow key once left out."""

import random
from collections import Counter

from pyspark.sql import functions as F

from hashloom.functions import bits
from hashloom.operators import bpe, search
from hashloom.plans import texts
from hashloom.streaming import state


def test_links_without_a_common_band(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = base + [b ^ 0x0001_0010_0100_1000 for b in base] + base[:5] + [b ^ rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64) for b in base]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    near = {i: [j for j, y in enumerate(hashes) if i != j and (x ^ y).bit_count() <= 20] for i, x in enumerate(hashes)}
    for cell in (16_384, 17):
        assert {r.id: r.n_links for r in search.all_links(rows, 20, cell).collect()} == {i: len(n) for i, n in near.items()}
    banded = search.band_links(rows, 20).agg(F.sum("n_links")).first()[0]
    assert banded < sum(map(len, near.values()))  # the candidate report misses pairs with a flip in each band
    queries = rows.filter("id < 9").select(F.col("id").alias("query"), F.col("hash").alias("qhash"))
    assert {r.query: r.id for r in search.first_within(queries, rows, 20).collect()} == {i: n[0] for i, n in near.items() if i < 9}


def test_turns_beyond_a_thousand(spark, tmp_path):
    rng = random.Random(6)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(rng.choices("abcdefgh", k=4)) + f" w{c} w{t}") for c, n in ((100, 1203), (101, 240), (102, 3)) for t in range(n)]
    rows = [(c, t, r, x + (" q" if c == 100 else "")) for c, t, r, x in rows]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sf = str(tmp_path)

    def number(c, t):
        return c * 1000 + t if t < 1000 else -(c * 2**31 + t)

    # each turn alone, under a plain number of its own
    alone = spark.createDataFrame([(i, x) for i, (*_, x) in enumerate(rows)], "i long, text string")
    hashes = {rows[r.i][:2]: r.hash for r in texts.token_simhash(texts.lexicon.term_counts(alone, "i", "text"), "i", "token", "tf").collect()}
    got = texts.text_simhash(spark, sf).collect()
    assert len(got) == len(rows) and {r.msg: r.hash for r in got} == {number(*k): h for k, h in hashes.items()}

    def mixed(c, t):
        h, p = hashes[c, t], hashes.get((c, t - 1), 0)
        return h if p == 0 else p & bits.HIGH | h & bits.LOW

    got = texts.context_mix(spark, sf).collect()
    assert len(got) == len(rows) and {r.msg: r.mixed for r in got} == {number(*k): mixed(*k) for k in hashes}
    users = [(c, t) for c, t, r, _ in rows if r == "user"]
    got = {r.query: (r.id, r.distance) for r in texts.qa_retrieval(spark, sf).collect()}
    want = {}
    for q in users:
        if q[0] % 100 == 0:
            d, k = min((((hashes[q] ^ hashes[k]) & (1 << 64) - 1).bit_count(), k) for k in users if k != q)
            want[number(*q)] = (number(*k), d)
    assert got == want


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :])


def test_rescue_over_documents(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 6)))
    known, asked = {word() for _ in range(60)}, {word() for _ in range(300)}
    for name, key, words in (("documents", "doc_id", known), ("benchmark", "item_id", asked), ("conversations", "conv_id", {"zzzzzz"})):
        spark.createDataFrame([(0, " ".join(sorted(words)))], f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
    want = {u: min(near) for u in asked - known if len(u) > 2 and (near := [k for k in known if one_edit(u, k)])}
    assert want and {r.token: r.match for r in texts.oov_rescue_documents(spark, str(tmp_path)).collect()} == want


def test_cache_keeps_old_hashes(spark, tmp_path):
    rng = random.Random(5)
    raw = [rng.getrandbits(64) for _ in range(1300)]
    raw += [raw[0] >> 32 << 32 | 77, raw[0]]  # the last turn, mixed with the one before, is the first turn's hash again
    rows = spark.createDataFrame([(1, t, h - (1 << 64) if h >> 63 else h) for t, h in enumerate(raw)], "conv_id long, turn long, hash long")
    rows.write.parquet(f"{tmp_path}/in")
    stream = state.semantic_cache(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), limit=0)
    q = stream.writeStream.format("memory").queryName("old").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    got = {r.turn: (r.action, r.distance) for r in spark.table("old").collect()}
    assert got.pop(1301) == ("hit", 0) and set(got.values()) == {("insert", -1)} and len(got) == 1301


def plain_merges(words, merges):
    table, out = {(*w, "</w>"): n for w, n in words}, []
    for rank in range(merges):
        pairs = Counter()
        for w, n in table.items():
            for pair in zip(w, w[1:], strict=False):
                pairs[pair] += n
        if not pairs:
            break
        (left, right), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((rank, left, right, n))
        table = {bpe.merged(w, left, right): n for w, n in table.items()}
    return out


def test_rare_words_count_in_merges(spark):
    rng = random.Random(4)
    words = [(w, rng.randint(1, 9)) for w in sorted({"".join(rng.choices("abcé😀", k=rng.randint(1, 7))) for _ in range(90)})]
    assert bpe.train(spark.createDataFrame(words, "word string, n long"), 25, every=4) == plain_merges(words, 25)
    # 100,000 commoner words of x and digits, and as many rare ones that all hold "yz"
    many = spark.range(100_000).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("word"), F.lit(2).cast("long").alias("n"))
    rare = spark.range(300_000).select(F.concat(F.lit("yz"), F.col("id").cast("string")).alias("word"), F.lit(1).cast("long").alias("n"))
    assert bpe.train(many.unionByName(rare), 1) == [(0, "y", "z", 300_000)]


def test_merges_are_learnt_from_the_documents(spark, sf):
    assert all(0 not in r.ids and r.decoded == r.word for r in texts.bpe_encode(spark, sf).collect())
