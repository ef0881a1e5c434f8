"""Exact deduplication with a log-structured merge index.

Rows arrive in batches. Tasks keep a memtable of text digests and flush it as a run sorted by digest; the runs of a batch
become one sorted run, dealt over files by ranges of digests, with one identifier and a count for each digest, and with a
filter. Runs of about one size are compacted into a larger one, which keeps the smallest (or largest) identifier. A
digest that occurs once in its run and that the filters of all other runs rule out is not moved again; the others are
summed over the runs. Rows with a digest that repeats look it up, and the identifier found there is the result once the
texts behind the digest have been compared byte by byte. A digest behind which texts differ is split by text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, discard, map_batches, materialize, sifted, texts_of, unused, with_row_key, without

#: Entries of a memtable before it is flushed.
MEMTABLE = 200_000

#: Runs of one size class that are compacted into one, and batches in which a table is added.
FANOUT, BATCHES = 2, 3

_RUN = "run long, digest binary, best long, n long"


def flush_runs(digests: DataFrame, keep: str, memtable: int = MEMTABLE) -> DataFrame:
    """(doc_id, digest) -> sorted runs of (run, digest, best id, count); rows of one digest in one memtable are merged."""
    better = max if keep == "max" else min

    def flush(table: dict, run: int):
        keys = sorted(table)
        for i in range(0, len(keys), 10_000):
            part = keys[i : i + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([run] * len(part), pa.int64()),
                    pa.array(part, pa.binary()),
                    pa.array([table[k][0] for k in part], pa.int64()),
                    pa.array([table[k][1] for k in part], pa.int64()),
                ],
                names=["run", "digest", "best", "n"],
            )

    def tasks(batches):
        table: dict[bytes, tuple] = {}
        run = 0
        for b in batches:
            for doc, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                old = table.get(digest)
                if old is None:
                    table[digest] = (doc, 1)
                else:
                    ids = [x for x in (old[0], doc) if x is not None]
                    table[digest] = (better(ids) if ids else None, old[1] + 1)
            if len(table) >= memtable:
                yield from flush(table, run)
                table, run = {}, run + 1
        yield from flush(table, run)

    return map_batches(digests.select("doc_id", "digest"), tasks, _RUN)


def compact(runs: DataFrame, keep: str, *levels: DataFrame) -> DataFrame:
    """One level of (digest, best, n) from runs and older levels: the merge keeps the smallest or largest identifier and adds counts.

    Runs are dealt by ranges of digests and sorted there, so entries of one digest meet as neighbours and the merge
    moves nothing again; a digest has one entry for each run at most, however many rows it has.
    """
    entries = runs.select("digest", "best", "n")
    for level in levels:
        entries = entries.unionByName(level.select("digest", "best", "n"))
    best = F.max("best") if keep == "max" else F.min("best")
    merged = entries.repartitionByRange("digest").sortWithinPartitions("digest").groupBy("digest").agg(best.alias("best"), F.sum("n").alias("n"))
    return merged.sortWithinPartitions("digest")


class Run:
    """A written sorted run of (digest, best, n) with its number of digests and its filter."""

    def __init__(self, rows: DataFrame):
        self.rows, self.filter = rows, KeyFilter(rows, ["digest"])
        self.n = self.filter.n


class DigestIndex:
    """Sorted runs of digests, newest first. add() takes a batch of (doc_id, digest); no batch is read a second time.

    Runs are compacted as soon as `fanout` neighbours are of one size class (sizes within a factor of `fanout`), so
    there are some log(digests) runs, and a digest is rewritten as often at most. An empty batch makes no run.
    """

    def __init__(self, keep: str = "min", memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.keep, self.memtable, self.fanout, self.runs = keep, memtable, fanout, []

    def add(self, digests: DataFrame) -> None:
        flushed = materialize(flush_runs(digests, self.keep, self.memtable), "runs")
        run = Run(materialize(compact(flushed, self.keep), "level"))
        discard(flushed)
        if run.n:
            self.runs.insert(0, run)
        while len(alike := self._alike()) >= self.fanout:
            merged = Run(materialize(compact(alike[0].rows, self.keep, *(r.rows for r in alike[1:])), "level"))
            discard(*(r.rows for r in alike))
            self.runs = [merged, *self.runs[len(alike) :]]

    def _alike(self) -> list[Run]:
        """The newest runs, as long as the next one is less than `fanout` times as large as the newest."""
        alike = self.runs[:1]
        for run in self.runs[1:]:
            if run.n >= self.fanout * alike[0].n:
                break
            alike.append(run)
        return alike

    def entries(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Entries (digest, best, n) in two parts: those that other runs may hold too, or whose digest occurs more than
        once; and those that the other runs' filters rule out. None: no runs."""
        shared, alone = [], []
        for run in self.runs:
            rest = run.rows.filter("n = 1")
            shared.append(run.rows.filter("n > 1"))
            for other in self.runs:
                if other is not run:
                    maybe, rest = other.filter.split(rest)
                    shared.append(maybe)
            alone.append(rest)
        return tuple(_union(x) if x else None for x in (shared, alone))

    def repeats(self) -> DataFrame | None:
        """(digest, best, n) of digests with n > 1 over all runs; None: no runs."""
        shared, _ = self.entries()
        if shared is None:
            return None
        best = F.max("best") if self.keep == "max" else F.min("best")
        return shared.groupBy("digest").agg(best.alias("best"), F.sum("n").alias("n")).filter("n > 1")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def lookup(digests: DataFrame, level: DataFrame) -> DataFrame:
    """Rows of digests with what a level knows of their digest: known_id and known_n (null: nothing)."""
    known = level.select("digest", F.col("best").alias("known_id"), F.col("n").alias("known_n"))
    return digests.join(known.hint("merge"), "digest", "left")


def exact_dedup(docs: DataFrame, keep: str = "min", digest_bytes: int = 32, memtable: int = MEMTABLE, carry: tuple[str, ...] = (), batches: int = BATCHES) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept, text_sha256, and the columns named by carry.

    Texts are equal if their bytes are; null counts as empty, and empty texts form one group. keep: min or max, of
    doc_id. Rows that repeat a doc_id are one document and share its fate, though each counts in group_size. A null
    doc_id never wins over another. The index takes docs in `batches` batches. keep_id and group_size are what it holds
    for a row's digest; rows whose digest occurs once are not looked up. digest_bytes below 32 only serves tests of collisions.
    """
    sha = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    cut, more = F.substring(sha, 1, digest_bytes), carry
    arrival = unused("_batch", ["doc_id", *more, "sha", "digest"])
    rows = texts_of(docs, *more).select("doc_id", *more, sha.alias("sha"), (F.monotonically_increasing_id() % batches).alias(arrival))
    numbered = materialize(rows.withColumn("digest", F.substring("sha", 1, digest_bytes)), "digests")
    index = DigestIndex(keep, memtable)
    for i in range(batches):
        index.add(numbered.filter(F.col(arrival) == i))
    digests = numbered.drop(arrival)
    found = index.repeats()
    repeats = materialize(found if found is not None else digests.select("digest", F.col("doc_id").alias("best"), F.lit(1).cast("long").alias("n")), "repeats")

    # byte verification: a task sends each text that may repeat once; digests behind which texts differ are few or none
    texts, _ = sifted(texts_of(docs, *more).select("doc_id", *more, "text", sha.alias("sha"), cut.alias("digest")), ["digest"], repeats)
    differ = texts.select("digest", "text").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    differ = materialize(differ, "differ")

    asking, single = sifted(digests, ["digest"], repeats)
    told = lookup(asking, repeats).select(*digests.columns, "known_id", "known_n")
    if not differ.isEmpty():
        mixed = sifted(texts, ["digest"], differ)[0].join(differ.hint("merge"), "digest", "left_semi")
        best = F.max("doc_id") if keep == "max" else F.min("doc_id")
        by_text = mixed.groupBy("digest", "text").agg(best.alias("known_id"), F.count(F.lit(1)).alias("known_n"))
        apart = mixed.join(materialize(by_text, "split").hint("merge"), ["digest", "text"]).select(*digests.columns, "known_id", "known_n")
        told = without(told, ["digest"], differ).unionByName(apart)
    nobody = F.lit(None).cast("long")
    out = told.unionByName(single.select(*digests.columns, nobody.alias("known_id"), nobody.alias("known_n")))
    keep_id = F.when(F.col("known_n") > 1, F.col("known_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "digest",
        keep_id.alias("keep_id"),
        F.coalesce("known_n", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *more,
    )


def kept_documents(docs: DataFrame, keep: str = "min") -> DataFrame:
    """docs without the later copies of equal texts, with docs' columns; rows are chosen by their row key, not by doc_id.

    Null doc_ids name no document: of a text that only such rows have, the first row stays. Repeated rows of the
    chosen doc_id all stay. Only rows that may be copies are shuffled with their text.
    """
    rows, key = with_row_key(docs)
    found = materialize(exact_dedup(rows, keep, carry=(key,)), "found")
    copies = found.filter("keep_id IS NOT NULL AND NOT kept").select(key)
    nameless = found.filter("keep_id IS NULL")
    first = nameless.groupBy("text_sha256").agg(F.min(key).alias("_first"))
    again = nameless.join(first.hint("merge"), "text_sha256").filter(F.col(key) > F.col("_first")).select(key)
    return without(rows, [key], materialize(copies.unionByName(again), "copies")).drop(key)
