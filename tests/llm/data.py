"""Documents that hold every odd case, and the columns that clash with names used inside the operators."""

import random

EXTRA = ["_dropped", "_first", "_row", "_word", "_bits", "row", "digest", "fp", "hub", "word", "number", "line", "n", "shard"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in EXTRA)


def texts(seed=3, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeioé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 14))) + "." for _ in range(rng.randint(1, 9))]
        out.append("\n".join(lines))
    return out


def documents(spark, rows=None):
    """rows: (doc_id, text); default: random texts with copies, near copies, nulls, blanks, a very long text, repeated rows."""
    if rows is None:
        base = texts()
        rows = list(enumerate(base))
        rows += [(1000 + i, base[i % 7]) for i in range(60)]
        rows += [(2000 + i, base[50 + i] + " x") for i in range(10)]
        rows += [(3000, None), (3001, ""), (3002, " \n\t "), (3003, None), (None, base[3]), (5, base[5]), (5, base[5])]
        rows += [(3100, "\n".join(base) * 4), (3101, "line\r\nother\x0bnext x 😀 漢字 Ünïcode İ Σς '’s don't 12ab ½   y"), (3102, "a  b   c    d\t\te ▁ f")]
        rows += [(3103, "<|endoftext|> a <|startoftext|>b"), (3104, "é <|ENDOFTEXT|> <|endoftext |>"), (3105, "x<|endoftext|>" * 3)]
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, "s", None, *EXTRA) for i, t in rows], SCHEMA)


def by_id(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out
