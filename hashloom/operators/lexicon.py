"""Vocabulary, TF-IDF and retrieval over text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.text import tokens


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, tf) of docs that have one row for each key: counted inside the row, nothing is shuffled.

    Sorted tokens lie in runs, so a token's count is the distance to the next run's start.
    """
    rows = docs.select(key, F.sort_array(tokens(F.col(text))).alias("_t"))
    # places where a run starts, and the end
    first = F.filter(F.transform("_t", lambda t, i: F.when((i == 0) | (t != F.get("_t", i - 1)), i)), lambda i: i.isNotNull())
    starts = rows.select(key, "_t", F.concat(first, F.array(F.size("_t"))).alias("_s"))
    runs = F.transform(F.slice("_s", F.lit(1), F.size("_s") - 1), lambda s, i: F.struct(F.get("_t", s).alias("token"), (F.get("_s", i + 1) - s).cast("long").alias("tf")))
    return starts.select(key, F.inline(runs))


def inverse_frequency(terms: DataFrame, key: str, n_docs: DataFrame) -> DataFrame:
    """(token, df, idf) with idf = ln((N+1)/(df+1)) + 1; n_docs is one row with N."""
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n_docs)).select("token", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def rarest(idf: DataFrame, most: int) -> DataFrame:
    """The `most` tokens of highest idf, by token among equals, with their place from 0: a top-k, not a full sort."""
    top = idf.orderBy(F.desc("idf"), "token").limit(most)
    return top.select("token", "df", "idf", (F.row_number().over(Window.orderBy(F.desc("idf"), "token")) - 1).cast("long").alias("place"))


def weighted(terms: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, token, weight): tf*idf scaled to length 1 in each document, which has its terms in one row once: no second join."""
    raw = terms.join(idf.select("token", "idf"), "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    held = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"), F.collect_list(F.struct("token", "w")).alias("_w"))
    return held.select(key, F.inline(F.transform("_w", lambda x: F.struct(x["token"].alias("token"), (x["w"] / F.col("_norm")).alias("weight")))))


def rescue(unknown: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, match): of unknown tokens longer than two letters, the first known token within one edit.

    Two words within one edit share a variant with one letter left out, or one is the other's variant; so candidates
    come from an equality join on variants, and only they are compared.
    """
    variants = lambda t: F.array_distinct(F.concat(F.array(t), F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substr(t, i + 1)))))
    u = unknown.filter(F.length("token") > 2).select("token", F.explode(variants(F.col("token"))).alias("v"))
    k = vocabulary.select(F.col("token").alias("match"), F.explode(variants(F.col("token"))).alias("v"))
    return u.join(k, "v").filter(F.levenshtein("token", "match") <= 1).groupBy("token").agg(F.min("match").alias("match"))
