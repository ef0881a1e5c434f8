"""Deletion of repeated line runs by a suffix array over line sequences, built by distributed prefix doubling.

Every place of a line is a suffix of its document. At level k, suffixes are named by the order of their first 2^k
lines; a name at level k+1 is the order of the pair of names at a place and 2^k lines on. Suffixes whose name nobody
shares take no further part, so the work follows what repeats. Suffixes that share at least m lines are an interval of
the suffix array with that longest common prefix; for 2^k <= m < 2^(k+1) the interval is named by two names of level k
that overlap. A window is the shortest run of enough words from a line on, or back from a line; windows that share an
interval with an earlier place are deleted, and together they make up the maximal repeated runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize, sifted, texts_of, without

#: A repeated run is deleted from this many words on, whatever its number of lines.
MIN_WORDS = 50

_PLACE = ["doc", "uid"]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc (doc_id; null: the smallest long), uid (a hash of the text, for rows that share a doc_id) and text."""
    return texts_of(docs, *more).withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "uid": F.xxhash64("text")})


def windows(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, the number of lines of the shortest run of `least` words from it on, and back from it (0: none)."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(counts)
    to = np.searchsorted(ends, starts + least, side="left")
    forward = np.where(to < n, to - np.arange(n) + 1, 0)
    since = np.searchsorted(starts, ends - least, side="right") - 1
    backward = np.where(ends >= least, np.arange(n) - since + 1, 0)
    return forward, backward


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, uid, row, line, digest, forward, backward) of every line of every text, split at line feeds; row numbers docs' rows."""

    def tasks(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            out = [[], [], [], [], [], [], []]
            for doc, uid, text in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                lines = text.encode().split(b"\n")
                n = len(lines)
                forward, backward = windows(np.fromiter((len(x.split()) for x in lines), np.int64, n), min_words)
                for held, new in zip(out, ([doc] * n, [uid] * n, [row] * n, range(n), [hashlib.blake2b(x, digest_size=16).digest() for x in lines], forward.tolist(), backward.tolist()), strict=True):
                    held.extend(new)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    names = [*_PLACE, "row", "line", "digest", "forward", "backward"]
    kinds = [pa.binary() if c == "digest" else pa.int64() for c in names]
    return map_batches(_keyed(docs).select(*_PLACE, "text"), tasks, ", ".join(f"{c} {'binary' if c == 'digest' else 'long'}" for c in names))


def one_of_equal_rows(lines: DataFrame) -> DataFrame:
    """Written lines without those of rows that repeat doc and text: only the row numbers of first lines are grouped."""
    often = lines.filter("line = 0").groupBy(*_PLACE).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_PLACE, "first")
    lost = lines.filter("line = 0").join(materialize(often, "often"), _PLACE).filter("row > first").select("row")
    return without(lines, ["row"], materialize(lost, "lost"))


def repeated(rows: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Written rows whose keys occur at more than one place, with `name`, a long in the order of the keys.

    Partitions of the sorted keys are ranges, and monotonically_increasing_id starts higher in each, so names keep
    the order; only keys that repeat are sorted, and only rows that pass their filter are joined.
    """
    often = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), "often")
    named = often.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())
    maybe, _ = sifted(rows, keys, often)
    return materialize(maybe.join(materialize(named, "named").hint("merge"), keys).select(*_PLACE, "line", *keep, "name"), "level")


def covered(level: DataFrame, spans: DataFrame, step: int) -> DataFrame:
    """Of spans (doc, uid, start, length) with step <= length < 2 step, those that an earlier place begins too.

    The first places are written before spans look theirs up, so that a common interval's spans can be dealt to several tasks.
    """
    head = level.select(*_PLACE, F.col("line").alias("start"), F.col("name").alias("a"))
    tail = level.select(*_PLACE, F.col("line").alias("_last"), F.col("name").alias("b"))
    both = spans.join(head, [*_PLACE, "start"]).withColumn("_last", F.col("start") + F.col("length") - step).join(tail, [*_PLACE, "_last"])
    both = materialize(both.select(*_PLACE, "start", "length", "a", "b"), "intervals")
    first = both.groupBy("length", "a", "b").agg(F.min(F.struct(*_PLACE, "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialize(first.select("length", "a", "b", "first"), "firsts")
    later = both.join(first.hint("merge"), ["length", "a", "b"]).filter(F.struct(*_PLACE, "start") > F.col("first")).select(*_PLACE, "start", "length")
    later = materialize(later, "covered")
    discard(both, first)
    return later


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, uid, start, length): windows of lines, overlapping ones too, that have an earlier copy; earlier is by doc_id, then line.

    Rows that repeat doc_id and text are one document.
    """
    lines = materialize(lines_of(docs, min_words), "lines")
    level = repeated(one_of_equal_rows(lines), ["digest"], ["forward", "backward"])
    discard(lines)
    spans = level.select(*_PLACE, F.col("line").alias("start"), F.col("forward").alias("length")).unionByName(level.select(*_PLACE, (F.col("line") - F.col("backward") + 1).alias("start"), F.col("backward").alias("length")))
    spans = materialize(spans.filter("length > 0").distinct(), "spans")
    longest = spans.agg(F.max("length")).first()[0] or 0
    first, step, found = level, 1, []
    level = level.select(*_PLACE, "line", "name")
    while step <= longest:
        found.append(covered(level, spans.filter((F.col("length") >= step) & (F.col("length") < 2 * step)), step))
        if 2 * step <= longest:
            ahead = level.select(*_PLACE, (F.col("line") - step).alias("line"), F.col("name").alias("b"))
            pairs = materialize(level.withColumnRenamed("name", "a").join(ahead, [*_PLACE, "line"]), "pairs")
            level = repeated(pairs, ["a", "b"], [])
            discard(pairs, first)
            first = level
        step *= 2
    if not found:
        return spans
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, deleted_lines, deleted (spans of lines, end exclusive), text (what stays).

    The first copy of a run, by doc_id and line, stays. Null texts come back empty, and empty texts stay as they are;
    an empty line is a line of no words. A document may lose all its lines; its row stays, with an empty text. Only
    texts that may lose lines are shuffled to meet their spans; the others pass in one map.
    """
    runs = repeated_runs(docs, min_words).groupBy(*_PLACE).agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    runs = materialize(runs, "runs")
    touched, whole = sifted(_keyed(docs), _PLACE, runs)
    rows = touched.join(runs.hint("merge"), _PLACE, "left").select("doc_id", "text", "spans")
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")

    def tasks(batches):
        for b in batches:
            out = [[], [], [], []]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, merged = text.split("\n"), []
                for s, e in sorted((x["start"], x["start"] + x["length"]) for x in spans or ()):
                    if merged and s <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], e)
                    else:
                        merged.append({"start": s, "end": e})
                stay, at = [], 0
                for m in merged:
                    stay += lines[at : m["start"]]
                    at = m["end"]
                stay += lines[at:]
                for held, x in zip(out, (len(lines), len(lines) - len(stay), merged, "\n".join(stay)), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_lines", "deleted_lines", "deleted", "text"])

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    schema = "doc_id long, n_lines long, deleted_lines long, deleted array<struct<start:long,end:long>>, text string"
    as_it_is = whole.select("doc_id", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("deleted_lines"), F.array().cast("array<struct<start:long,end:long>>").alias("deleted"), "text")
    return map_batches(rows, tasks, schema).unionByName(as_it_is)
