"""Pieces of the SQL that states each query a second time, for another engine."""

from hashloom.functions.text import ACCENTED, PLAIN

HASHES = """
planes AS (SELECT f, i, list_transform(range(64), lambda j: ((((i+64*f)*131 + j*71 + (i+64*f)*j*37 + (i+64*f+1)*(j+1)*(j+3)) % 201) - 100)::DOUBLE) AS w FROM range(64) a(i), range(3) b(f)),
signs AS (SELECT vec_id, label, f, sum(CASE WHEN list_inner_product(embedding::DOUBLE[], w) > 0 THEN 1::HUGEINT << i::INT ELSE 0 END) AS u FROM embeddings, planes GROUP BY vec_id, label, f),
hashes AS (SELECT vec_id, label, f, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS h FROM signs),
one AS (SELECT vec_id, label, h FROM hashes WHERE f = 0),
three AS (SELECT a.vec_id, a.label, a.h AS e, b.h AS c, d.h AS v FROM hashes a JOIN hashes b ON a.vec_id = b.vec_id AND a.f = 0 AND b.f = 1 JOIN hashes d ON a.vec_id = d.vec_id AND d.f = 2)"""


def dist(a: str, b: str) -> str:
    return f"bit_count(xor({a}, {b}))::BIGINT"


def prefix(h: str, bits: int) -> str:
    """Top bits of a signed long; without a logical shift: arithmetic shift, then mask."""
    return f"(({h} >> {64 - bits}) & {(1 << bits) - 1})"


PAIRS = f"pairs AS (SELECT q.vec_id AS query, r.vec_id AS id, q.h AS qh, r.h AS h, {dist('q.h', 'r.h')} AS distance FROM one q, one r WHERE q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id)"
NEAREST = "near AS (SELECT query, arg_min(id, (distance, id)) AS id, min(distance) AS distance FROM pairs GROUP BY query)"

FOLDED = f"lower(translate(text, '{ACCENTED}', '{PLAIN}'))"
TOKENS = f"regexp_extract_all({FOLDED}, '[a-z0-9]+')"


def bags(table: str, key: str, where: str = "true") -> str:
    return f"terms AS (SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest({TOKENS}) AS token FROM {table} WHERE {where}) GROUP BY ALL)"


def token_hash(bag: str, key: str, weight: str, name: str) -> str:
    bit = "(instr('0123456789abcdef', substr(md5(token), (i // 4 + 1)::INT, 1)) - 1) >> (3 - i % 4)::INT & 1"
    return f"""{name}_s AS (SELECT {key}, i, sum({weight} * (2 * ({bit}) - 1)) AS s FROM {bag}, range(64) t(i) GROUP BY {key}, i),
{name}_u AS (SELECT {key}, sum(CASE WHEN s > 0 THEN 1::HUGEINT << i::INT ELSE 0 END) AS u FROM {name}_s GROUP BY {key}),
{name} AS (SELECT {key}, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash FROM {name}_u)"""


def mask(key: str, sixteenths: str) -> str:
    """bernoulli_mask as SQL (signed)."""
    hexes = f"(md5({key} || ':a') || md5({key} || ':b'))"
    u = f"list_sum(list_transform(range(64), lambda i: CASE WHEN instr('0123456789abcdef', substr({hexes}, (i + 1)::INT, 1)) - 1 < {sixteenths} THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))"
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)::BIGINT"
