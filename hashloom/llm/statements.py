"""SQL that states queries of this subpackage a second time, for another engine."""

EXACT = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

PHRASES = r"""
WITH folded AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM folded),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM cand
    UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM cand WHERE k = 3),
scored AS (SELECT c.lang, c.phrase, a, cut, h.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * r.f) AS score
    FROM cuts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase),
low AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score)::BIGINT AS score FROM scored GROUP BY lang, phrase, a),
inner_parts AS (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM cand WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM cand WHERE k = 3),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_parts GROUP BY ALL),
kept AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
    FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) WHERE rank <= 2000"""


def _said(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(map(_said, ("doc_id", "source", "lang", "n_chars")))
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda k: k::BIGINT)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))"""


def _tree(name: str, leaves: str) -> str:
    """Nodes (grp, lv, i, n, h) of each group's tree over leaves (grp, i, n, h)."""
    return f"""{name} AS (SELECT grp, 0 AS lv, i, n, h FROM {leaves}
    UNION ALL SELECT grp, lv + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY grp, lv, i // 3, n)"""


def _climbed(name: str, tree: str, start: str) -> str:
    """(r, grp, lv, i, h, told, others): what a row (r, grp, i, h, told) becomes level by level, and the siblings met so far."""
    return f"""{name} AS (SELECT r, grp, 0 AS lv, i, told, others FROM {start}
    UNION ALL SELECT a.r, a.grp, a.lv + 1, a.i // 3, sha256(string_agg(CASE WHEN t.i = a.i THEN a.told ELSE t.h END, '' ORDER BY t.i)),
        a.others || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> a.i), '')
    FROM {name} a JOIN {tree} t ON a.grp IS NOT DISTINCT FROM t.grp AND a.lv = t.lv AND a.i // 3 = t.i // 3 WHERE t.n > 1 GROUP BY a.r, a.grp, a.lv, a.i, a.others)"""


MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source AS grp, sha256({_HEAD} || {_said("text")}) AS h,
    sha256({_HEAD} || {_said("CASE WHEN doc_id IS NOT NULL AND xor(" + _CRC + ", 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS told FROM documents),
leaves AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_tree("t", "leaves")},
subroots AS (SELECT 0 AS grp, grp AS source, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM t WHERE n = 1),
{_tree("u", "subroots")},
root AS (SELECT h AS root FROM u WHERE n = 1),
started AS (SELECT r, grp, i, told, '' AS others FROM leaves),
{_climbed("a", "t", "started")},
topped AS (SELECT a.r, 0 AS grp, s.i, told, others, s.h AS subroot FROM a JOIN subroots s ON a.grp IS NOT DISTINCT FROM s.source JOIN t ON t.grp IS NOT DISTINCT FROM a.grp AND t.lv = a.lv AND t.n = 1),
{_climbed("b", "u", "topped")},
done AS (SELECT b.* FROM b JOIN u ON u.lv = b.lv AND u.n = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, root, sha256(others) AS proof_sha256, done.told AS folded_root, done.told = root AS verified
FROM done JOIN leaves l USING (r) JOIN subroots s ON s.source IS NOT DISTINCT FROM l.grp, root"""
