"""Operators 11 to 13: phrases from bitmaps, byte-level ranks, Merkle manifests."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from hashloom.llm import merkle, phrases, queries, rankbytes, statements

from .data import documents

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).withColumn("source", F.expr("CASE doc_id % 3 WHEN 0 THEN 'ä' WHEN 1 THEN 'z' END")).withColumn("n_chars", F.expr("CASE WHEN doc_id % 5 > 0 THEN length(text) END")).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def stated(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    return con.execute(sql).fetchdf()


def alike(df, other):
    text = lambda v: "null" if v is None or v != v else v if isinstance(v, str) else f"{v:.12g}"
    told = lambda x: sorted(tuple(map(text, r)) for r in x[sorted(x.columns)].astype(object).where(x.notna(), None).itertuples(index=False))
    assert sorted(df.columns) == sorted(other.columns)
    assert told(df) == told(other)


# 11: phrases


def counted(rows, longest):
    """Brute force: (lang, words) -> occurrences."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def mined(rows, longest, least, covered, top=None):
    out = []
    for lang, c in counted(rows, longest).items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = [p for p, a in cand.items() if not any(inside(p, q) and 100 * b >= covered * a for q, b in cand.items())]
        lows = {p: min((1000000 * c[p] ** 2 // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p))) for p in kept}
        kept.sort(key=lambda p: (-lows[p][0], -c[p], " ".join(p).encode()))
        n = sum(a for p, a in c.items() if len(p) == 1)
        out += [(lang, i + 1, " ".join(p), c[p], c[p[: lows[p][1]]], c[p[lows[p][1] :]], n, lows[p][0]) for i, p in enumerate(kept[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest, least, top, shard_words, cut", [(3, 10, 2000, 1 << 20, 1 << 20), (3, 2, None, 500, 100), (4, 2, 7, 3000, 1), (2, 3, None, 1, 64)])
def test_phrases(docs, monkeypatch, longest, least, top, shard_words, cut):
    """Repeats, ties, nulls, blanks, texts longer than a shard; pieces that run over a shard's end."""
    monkeypatch.setattr(phrases, "CUT_BYTES", cut)
    rows = docs.select("lang", "text").collect()
    if longest == 4:
        rows, docs = rows[:25], docs.sparkSession.createDataFrame(rows[:25], docs.select("lang", "text").schema)
    found = phrases.mine_phrases(docs, longest, least, top, 50, shard_words)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in found.collect()) == mined(rows, longest, least, 50, top)


def test_phrases_against_sql(spark, docs, sf):
    alike(phrases.mine_phrases(docs).select(*COLUMNS).toPandas(), stated(statements.PHRASES, docs))
    own = spark.read.parquet(f"{sf}/documents.parquet")
    alike(queries.op11_phrases(spark, sf).toPandas(), stated(statements.PHRASES, own))


@pytest.mark.parametrize("blocks", [1, 5, 1 << 18])
def test_bitmaps_find_every_run(monkeypatch, blocks):
    """Runs over block borders, repeats that overlap, gaps, and any slice of first words."""
    monkeypatch.setattr(phrases, "SLICE_BLOCKS", blocks)
    rng = random.Random(4)
    tokens = [rng.choice([b"a", b"a", b"b", b"c", b"."]) for _ in range(700)]
    for starts in (0, 1, 63, 64, 65, 640, 700):
        shard = phrases.Shard()
        shard.add(tokens, starts)
        shard.add(tokens[:70], 70)
        words, got = list(shard.names), defaultdict(Counter)
        for n, ids, f in phrases.mine(shard, 4):
            got[n].update({tuple(words[x] for x in row): int(c) for row, c in zip(ids.tolist(), f, strict=True)})
        for n in range(1, 5):
            want = Counter(t for run, k in ((tokens, starts), (tokens[:70], 70)) for i in range(k) if len(t := tuple(run[i : i + n])) == n and b"." not in t)
            assert got[n] == want


def test_a_filter_that_lets_all_pass_changes_nothing(docs, monkeypatch):
    want = phrases.mine_phrases(docs, 3, 3).collect()
    monkeypatch.setattr(phrases, "FILTER_WORDS", 64)
    assert sorted(phrases.mine_phrases(docs, 3, 3).collect()) == sorted(want)


def test_scores_are_exact(spark):
    """Counts whose products pass 64 bits: the same arithmetic on stated numbers."""
    a, l, r = 4_000_000_007, 4_000_000_009, 5_000_000_029
    expr = "(CAST(1000000 AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0))) div (CAST({l} AS DECIMAL(38,0)) * CAST({r} AS DECIMAL(38,0)))"
    assert spark.sql("SELECT " + expr.format(a=a, l=l, r=r)).first()[0] == 1000000 * a * a // (l * r)


def test_phrases_empty(none, spark):
    assert phrases.mine_phrases(none).count() == 0
    assert phrases.mine_phrases(documents(spark, [(1, None), (2, ""), (3, " .,\t")])).count() == 0


# 12: byte-level ranks


def merged(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if best[0] == 1 << 40:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.mark.parametrize("most", [rankbytes.PIECE_CHARS, 40, 1])
def test_ranks_against_merges(docs, ranks, most):
    """Each match of the pattern merged by itself, whether texts are cut or not; special names are plain text."""
    known = {}
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = []
    for doc, text in rows:
        ids = []
        for word in regex.findall(PATTERN, text):
            if word not in known:
                known[word] = merged(word.encode(), ranks)
            ids += known[word]
        want.append((str(doc), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), True, str(ids)))
    got = rankbytes.encode(docs, RANKS, PATTERN, most=most).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip, str(r.ids)) for r in got) == sorted(want)


def test_ranks_decode(spark, docs):
    encoded = rankbytes.encode(docs, RANKS, PATTERN)
    back = {(r.doc_id, bytes(r.bytes).decode()) for r in rankbytes.decode(encoded, RANKS, PATTERN).collect()}
    assert back == {(r.doc_id, r.text or "") for r in docs.collect()}
    half = spark.createDataFrame([(1, [rankbytes.encoding(RANKS, PATTERN).encode_single_token(b"\xc3")]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r.bytes and bytes(r.bytes) for r in rankbytes.decode(half, RANKS, PATTERN).orderBy("doc_id").collect()] == [b"\xc3", None, b""]


@pytest.mark.parametrize("text", [" " * 600_000 + "x", "ab1 " * 200_000, "x" * 600_000, "漢字" * 200_000, "don't stop.\n" * 60_000])
def test_ranks_of_very_long_texts(spark, text):
    whole = rankbytes.encoding(RANKS, PATTERN).encode_ordinary(text)
    row = rankbytes.encode(documents(spark, [(1, text)]), RANKS, PATTERN).first()
    assert row.ids == whole and row.round_trip


def test_ranks_empty(none):
    assert rankbytes.encode(none, RANKS, PATTERN).count() == 0


# 13: Merkle manifest


def test_merkle_against_sql(spark, docs, sf):
    alike(merkle.proofs(docs).toPandas(), stated(statements.MERKLE, docs))
    alike(queries.op13_merkle(spark, sf).toPandas(), stated(statements.MERKLE, spark.read.parquet(f"{sf}/documents.parquet")))


def said(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes, fanout=3):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([merkle.sha(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


@pytest.mark.parametrize("levels, bucket", [(2, 4), (1, 30)])
def test_merkle_in_blocks_and_buckets(spark, docs, levels, bucket):
    """Small blocks and buckets make several tiers and refinements; null and repeated doc_ids, a null source."""
    rows = docs.collect()
    leaf = lambda r, text: merkle.sha(map(said, (r.doc_id, r.source, r.lang, r.n_chars, text)))
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = tree([leaf(r, r.text) for r in by[s]])
    top = tree([trees[s][-1][0] for s in sources])
    want = []
    for j, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            odd = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 2
            node = leaf(r, r.text if odd or r.text is None else r.text.replace("\n", ""))
            path = []
            for nodes, at in ((trees[s], i), (top, j)):
                for below in nodes[:-1]:
                    run = below[at - at % 3 : at - at % 3 + 3]
                    others = run[: at % 3] + run[at % 3 + 1 :]
                    path += others
                    node = merkle.sha([*others[: at % 3], node, *others[at % 3 :]])
                    at //= 3
            want.append((str(r.doc_id), trees[s][0][i], trees[s][-1][0], top[-1][0], merkle.sha(path), node, node == top[-1][0]))
    assert sorted((str(r[0]), *r[1:]) for r in merkle.proofs(docs, 3, levels, bucket).collect()) == sorted(want)
    assert {(r.source, r.rows, r.subroot, r.root) for r in merkle.manifest(docs, 3, levels, bucket).collect()} == {(s, len(by[s]), trees[s][-1][0], top[-1][0]) for s in sources}


def test_ranks_of_any_keys(spark):
    """Clustered keys, keys that begin others, hot prefixes: the rank is the place in order."""
    rng = random.Random(8)
    keys = {f"{x:x}" for x in range(300)} | {"ff" * 8 + f"{rng.randrange(1 << 40):010x}" for _ in range(400)} | {"", "f", "ff" * 9}
    rows = [(g, k) for g in ("a", "b") for k in keys if g == "a" or len(k) < 3]
    table = spark.createDataFrame(rows, "grp string, key string")
    for bucket in (3, 50):
        want = {(g, k, i, len(o)) for g in ("a", "b") for o in [sorted(k for h, k in rows if h == g)] for i, k in enumerate(o)}
        assert {(r.grp, r.key, r["rank"], r.total) for r in merkle.ranked(table, bucket).collect()} == want


def test_merkle_lone_rows_and_none(spark, none):
    one = merkle.proofs(documents(spark, [(7, "a\nb")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == merkle.sha([])
    assert merkle.proofs(none).count() == 0 and merkle.manifest(none).count() == 0
