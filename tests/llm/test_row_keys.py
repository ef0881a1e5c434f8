"""Null and repeated doc_ids of different texts: every stage and run() drop rows, not ids."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest

from hashloom.llm import exactdedup, packing, simhash, toxicity

from .data import texts
from .test_operators import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string"


def survivors(rows, keep, group, best):
    """Of each group the rows of the best doc_id; without any doc_id, one row (any: they differ in nothing that is compared)."""
    groups = defaultdict(list)
    for i in keep:
        groups[group[i]].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [i for i in members if rows[i][0] == best(ids)] if ids else members[:1]
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    base = [t for t in texts(5, 700) if len(t.split()) > 8]
    rows = [(i, t + (" vile rotten" if i % 6 == 0 else ""), "en") for i, t in enumerate(base[:500])]
    labels = [(i, int(i % 6 == 0)) for i in range(500)]
    new = iter(base[500:])
    rows += [(None, next(new), "en") for _ in range(6)]  # null ids of sole texts
    rows += [(None, rows[i][1], "en") for i in (1, 2, 3)]  # and of copies
    twin = next(new)
    rows += [(None, twin, "en")] * 3  # copies among null ids alone
    rows += [(None, rows[i][1].upper(), "en") for i in (4, 5, 7)]  # equal fingerprints, other bytes
    near = next(new)
    rows += [(None, near, "en"), (None, near.upper(), "en")]
    rows += [(None, next(new) + " vile rotten vile rotten", "en") for _ in range(3)]
    for i in range(800, 806):  # one id: a sole text and a copy, a near copy, a rejected text
        rows += [(i, next(new), "en"), (i, rows[i - 780][1], "en"), (i, rows[i - 770][1].upper(), "en"), (i, next(new) + " vile rotten vile rotten", "en")]
    rows += [(900, next(new), "en")] * 2
    rng.shuffle(rows)
    return rows, labels


def test_rows_are_dropped_not_ids(spark, corpus, tmp_path):
    rows, labels = corpus
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    frame(rows).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, table = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    got = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    want = lambda part: Counter(rows[i][:2] for i in part)
    every = range(len(rows))

    # scores depend on the text and the language alone, so rows are scored under numbers of their own
    numbered = frame([(i, *r[1:]) for i, r in enumerate(rows)])
    flagged = {r.doc_id for r in toxicity.score(numbered, toxicity.fit(docs, table)).collect() if r.flagged}
    clean = [i for i in every if i not in flagged]
    assert any(rows[i][0] is None for i in flagged) and any(rows[i][0] == rows[j][0] for i in flagged for j in clean if rows[i][0] is not None)
    assert got(toxicity.not_toxic(docs, table)) == want(clean)

    text_of = [t for _, t, _ in rows]
    assert got(exactdedup.kept_documents(docs, "max")) == want(survivors(rows, every, text_of, max))

    fps = [plain_fingerprint(t) for t in text_of]
    folded = lambda counted: Counter((i, t.lower() if i is None else t) for (i, t), n in counted.items() for _ in range(n))
    assert folded(got(simhash.one_per_group(docs, radius=2, width=3))) == folded(want(survivors(rows, every, components_of(fps, every), min)))

    kept = survivors(rows, clean, text_of, max)
    kept = survivors(rows, kept, components_of(fps, kept), min)
    packed = lambda df: near_rows(Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect()))
    plain = packing.pack(frame([rows[i] for i in kept]), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert packed(out) == packed(plain)


def components_of(fps, part):
    """Of each row its component, named by the least row number."""
    part = list(part)
    return dict(zip(part, plain_components(part, [fps[i] for i in part]), strict=True))


def near_rows(counted):
    """Rows with an id as they are; of null ids only how many: which of a component's nameless rows stays is open."""
    out = Counter({k: n for k, n in counted.items() if k[0] is not None})
    out[None] = sum(n for k, n in counted.items() if k[0] is None)
    return out
