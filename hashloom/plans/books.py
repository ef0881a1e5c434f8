"""Queries over codebooks carried over, and lossy choices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from hashloom.operators import chunks, transfer

from .content import _PACKED, packed
from .texts import _BUCKET, chunk_counts, fixed_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _elite(name: str, counts: str, most: int) -> str:
    return f"{name}_c AS (SELECT *, {_BUCKET} AS bucket FROM {counts} QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, hex) <= 8), {name} AS (SELECT hex, n FROM {name}_c ORDER BY n DESC, hex LIMIT {most})"


_TRANSFER = f"""{fixed_sql(128)}, en AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 0 GROUP BY hex), odd AS (SELECT hex, count(*) AS n FROM c WHERE length(hex) = 256 AND doc_id % 2 = 1 GROUP BY hex),
{_elite('base', 'en', 1024)}, {_elite('own', 'odd', 2048)},
merged AS (SELECT base.hex, coalesce(odd.n, 0) AS n, CASE WHEN odd.n > 0 THEN 'base' ELSE 'idle' END AS origin FROM base LEFT JOIN odd USING (hex) UNION ALL SELECT hex, n, 'new' FROM own WHERE hex NOT IN (SELECT hex FROM base)),
book AS (SELECT row_number() OVER (ORDER BY list_position(['base', 'new', 'idle'], origin), n DESC, hex) - 1 AS place, origin, n, hex FROM merged QUALIFY place < 2048)"""


def _books(spark, sf_dir):
    base = chunks.elite(chunk_counts(spark, sf_dir, "doc_id % 2 = 0"), 8, 1024).select("id", "data")
    return base, chunk_counts(spark, sf_dir, "doc_id % 2 = 1")


@query(f"WITH {_TRANSFER} SELECT place, origin, n, md5(hex) AS chunk_md5 FROM book")
def codebook_transfer(spark, sf_dir):
    """The even documents' codebook carried over to the odd ones, in 2048 words."""
    base, counts = _books(spark, sf_dir)
    return transfer.transferred(base, counts, 2048).select("place", "origin", "n", F.md5(F.hex("data")).alias("chunk_md5"))


_COVER = "(SELECT count(*) FROM {b}) AS words, (SELECT count(*) FROM {b} WHERE hex IN (SELECT hex FROM own)) AS shared, (SELECT coalesce(sum(odd.n), 0)::BIGINT FROM {b} JOIN odd USING (hex)) AS covered"


@query(f"WITH {_TRANSFER} SELECT 'base' AS book, {_COVER.format(b='base')} UNION ALL SELECT 'transferred', {_COVER.format(b='book')} UNION ALL SELECT 'own', {_COVER.format(b='own')}")
def codebook_transfer_overlap(spark, sf_dir):
    """What the odd documents' own codebook shares with the one carried over, and with it before that; and the chunks each covers."""
    base, counts = _books(spark, sf_dir)
    own = chunks.elite(counts, 8, 2048)
    books = {"base": base, "transferred": transfer.transferred(base, counts, 2048), "own": own}
    told = [transfer.coverage(b, own, counts).select(F.lit(name).alias("book"), "*") for name, b in books.items()]
    return reduce(lambda a, b: a.unionByName(b), told)


@query(f"""WITH {_PACKED}, w AS (SELECT doc_id, chunk_no, CASE WHEN decision <> 'literal' THEN m.distance END AS distance, 0.05 * 1024 * count(*) OVER (PARTITION BY doc_id) AS budget FROM k),
s AS (SELECT *, distance IS NOT NULL AND sum(distance) OVER (PARTITION BY doc_id ORDER BY distance NULLS LAST, chunk_no ROWS UNBOUNDED PRECEDING) <= budget AS lossy FROM w)
SELECT doc_id, count(*) AS chunks, count(*) FILTER (lossy) AS given_up, coalesce(sum(distance) FILTER (lossy), 0)::BIGINT AS changed_bits, (128 * count(*) FILTER (lossy))::BIGINT AS saved FROM s GROUP BY doc_id""")
def lossy_choice(spark, sf_dir):
    """Odd documents packed with the even ones' codebook at a loss: residuals dropped as long as at most a twentieth of a document's bits change."""
    rows, _ = packed(spark, sf_dir)
    rows = rows.select("doc_id", "chunk_no", F.when(F.col("decision") != "literal", F.col("distance")).alias("distance"), (8 * F.length("data")).alias("bits"))
    chosen = transfer.given_up(rows, "doc_id", 0.05)
    lossy = F.col("lossy")
    return chosen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(lossy).alias("given_up"), F.coalesce(F.sum(F.when(lossy, F.col("distance"))), F.lit(0)).alias("changed_bits"), (128 * F.count_if(lossy)).alias("saved"))
