"""A Merkle manifest of a dataset: ranks from digit histograms, a trie of rank digits, proofs for every row.

Rows of a group are ranked without sorting the group: histograms of the key's leading digits are refined where a bucket
is too full; a bucket's offset is the sum of what stands before it at each level of digits; only inside a small bucket
are rows sorted. Ranks in the base of the tree's fanout are the trie's keys: nodes that share all but their last digits
meet as one block, which is reduced several levels at once, and block roots go on with the digits that are left. On
the way down each block hands its rows the siblings above it.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Rows of a bucket that are sorted together at most; hexadecimal digits by which a histogram is refined (16^3 children).
BUCKET, DIGITS = 4096, 3

#: Children of a node, and levels that one block reduces (3^7 = 2187 nodes of a block at most).
FANOUT, LEVELS = 3, 7


def sha(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def _before(over: Window) -> Column:
    return F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _prefix(length) -> Column:
    return F.substring(F.col("key"), F.lit(1), length if isinstance(length, Column) else F.lit(length))


def ranked(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows (a written table with strings grp and key, and more) with rank (from 0, by key) and total, both within grp.

    Keys are hexadecimal, compared as strings, and distinct within grp. No step sorts or sums more than a bucket or one
    node's 16^DIGITS children. A key that many rows begin with is refined by its further digits.
    """
    size, lo, hi = rows.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    if not size:
        return rows.withColumns({"rank": F.lit(0).cast("long"), "total": F.lit(0).cast("long")})
    shared = common_prefix(lo, hi)
    first = shared + max(1, math.ceil(math.log(max(4 * size / bucket, 1), 16)))
    seen = [F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")]

    # the first histogram, and what stands before each of its buckets, summed digit by digit from coarse to fine
    open_rows = rows.withColumn("at", _prefix(first))
    found = materialize(open_rows.groupBy("grp", "at").agg(*seen), "digits")
    lengths = list(range(first, shared, -DIGITS))
    levels = [found.select("grp", "at", "n")]
    for length in lengths[1:]:
        levels.append(materialize(levels[-1].groupBy("grp", F.substring("at", 1, length).alias("at")).agg(F.sum("n").alias("n")), "digits"))
    sums = levels[-1].groupBy("grp").agg(F.sum("n").alias("total"))
    over = Window.partitionBy("grp").orderBy("at")
    placed = levels[-1].withColumn("start", _before(over)).join(sums, "grp")
    for level, length in zip(levels[-2::-1], lengths[:0:-1], strict=True):
        above = placed.select("grp", F.col("at").alias("up"), F.col("start").alias("up_start"), "total")
        own = level.withColumn("up", F.substring("at", 1, length))
        own = own.withColumn("start", _before(Window.partitionBy("grp", "up").orderBy("at")))
        placed = own.join(above, ["grp", "up"]).select("grp", "at", "n", (F.col("start") + F.col("up_start")).alias("start"), "total")
    starts = materialize(placed.select("grp", "at", "n", "start", "total"), "starts")

    out = []
    while True:
        closed = starts.filter(F.col("n") <= bucket).select("grp", "at", "start", "total")
        rank = F.col("start") + F.row_number().over(Window.partitionBy("grp", "at").orderBy("key")) - 1
        out.append(open_rows.join(closed, ["grp", "at"]).withColumn("rank", rank).select(*(F.col(f"`{c}`") for c in rows.columns), "rank", "total"))
        full = found.filter(F.col("n") > bucket)
        if full.isEmpty():
            break
        more = F.expr("aggregate(sequence(1, length(lo)), 0, (m, i) -> IF(m = i - 1 AND substring(lo, i, 1) = substring(hi, i, 1), i, m))") + DIGITS
        wider = materialize(full.select("grp", F.col("at").alias("up"), more.cast("int").alias("length")), "full")
        inner = open_rows.withColumnRenamed("at", "up").join(wider, ["grp", "up"])
        open_rows = materialize(inner.withColumn("at", _prefix(F.col("length"))).drop("length"), "open")
        found = materialize(open_rows.groupBy("grp", "up", "at").agg(*seen), "digits")
        above = starts.select("grp", F.col("at").alias("up"), F.col("start").alias("up_start"), "total")
        own = found.withColumn("start", _before(Window.partitionBy("grp", "up").orderBy("at"))).join(above, ["grp", "up"])
        starts = materialize(own.select("grp", "at", "n", (F.col("start") + F.col("up_start")).alias("start"), "total"), "starts")
        open_rows, found = open_rows.drop("up"), found.drop("up")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def reduce_levels(digests: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level, from digests up."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([sha(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _block_levels(total: int, fanout: int, levels: int) -> int:
    """A block of the last tier reaches the root, others all their levels."""
    return min(levels, depth(total, fanout)) if total <= fanout**levels else levels


def climb(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(grp, rank, total, digest, and more) -> the blocks of each tier (grp, block, total, nodes) and roots (grp, digest).

    Nodes whose ranks differ in their last `levels` digits (in base fanout) alone are one block: one row, with nodes in order.
    """
    width, tiers, roots = fanout**levels, [], []
    most = nodes.agg(F.max("total")).first()[0] or 0

    def tasks(batches):
        for b in batches:
            out = []
            for grp, block, total, digests in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own = _block_levels(total, fanout, levels)
                out.append((grp, block, 1 if total <= width else -(-total // width), reduce_levels(digests, own, fanout)[-1][0]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["grp", "rank", "total", "digest"])

    while True:
        carried = [c for c in nodes.columns if c not in ("grp", "rank", "total")]
        block = F.expr(f"rank div {width}").alias("block")
        grouped = nodes.groupBy("grp", block).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", *carried))).alias("nodes"))
        tiers.append(materialize(grouped, "blocks"))
        up = map_batches(tiers[-1].select("grp", "block", "total", F.col("nodes.digest").alias("digests")), tasks, "grp string, rank long, total long, digest string")
        up = materialize(up, "tier")
        roots.append(up.filter("total = 1").select("grp", "digest"))
        if most <= width:
            break
        nodes, most = up.filter("total > 1"), -(-most // width)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return tiers, every


#: The siblings of a node at each level, from below: its place in its run, and the run's others.
_PATH = "array<struct<place int, others array<string>>>"


def _paths(levels: list[list[str]], i: int, fanout: int) -> list[tuple[int, list[str]]]:
    out = []
    for nodes in levels[:-1]:
        first, place = i - i % fanout, i % fanout
        run = nodes[first : first + fanout]
        out.append((place, run[:place] + run[place + 1 :]))
        i //= fanout
    return out


def fold(digest: str, path) -> str:
    """The root that a node and its siblings give."""
    for place, others in path:
        digest = sha([*others[:place], digest, *others[place:]])
    return digest


def _above(tier: DataFrame, tops: DataFrame, children: DataFrame | None, width: int) -> DataFrame:
    """Blocks of a tier with their roots' path: the group's own where the block is the whole tree, else what the next tier found."""
    more = [c for c in tops.columns if c not in ("grp", "path")]
    whole = tier.filter(F.col("total") <= width).join(tops, "grp").select(*tier.columns, "path", *more)
    if children is None:
        return whole
    part = tier.filter(F.col("total") > width).join(children.withColumnRenamed("rank", "block"), ["grp", "block"])
    return whole.unionByName(part.select(*tier.columns, "path", *more))


def descend(tiers: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Blocks of the lowest tier with the path of each block's root; tops: (grp, path of the group's root, and more), kept as they are."""
    width, found = fanout**levels, None
    more = [f"{f.name} {f.dataType.simpleString()}" for f in tops.schema if f.name not in ("grp", "path")]
    for tier in tiers[:0:-1]:
        blocks = _above(tier, tops, found, width).withColumn("digests", F.col("nodes.digest"))
        found = materialize(node_paths(blocks, [x.split(" ")[0] for x in more], ", ".join(["grp string", "rank long", f"path {_PATH}", *more]), fanout, levels), "paths")
    return _above(tiers[0], tops, found, width)


def node_paths(blocks: DataFrame, carried: list[str], schema: str, fanout: int, levels: int) -> DataFrame:
    """(grp, rank, path, and carried columns) of each node of blocks (which have digests, and their roots' path)."""
    path_type = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))

    def tasks(batches):
        for b in batches:
            for row in b.to_pylist():
                nodes = reduce_levels(row["digests"], _block_levels(row["total"], fanout, levels), fanout)
                upper, n = [(x["place"], x["others"]) for x in row["path"]], len(row["digests"])
                paths = [[{"place": p, "others": o} for p, o in _paths(nodes, i, fanout) + upper] for i in range(n)]
                first = row["block"] * fanout**levels
                columns = [pa.array([row["grp"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(paths, path_type)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([row[c]] * n) for c in carried)], names=["grp", "rank", "path", *carried])

    return map_batches(blocks.select("grp", "block", "total", "digests", "path", *carried), tasks, schema)


def _said(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of documents with this text."""
    return F.sha2(F.encode(F.concat(*(_said(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _said(text)), "UTF-8"), 256)


def _leaves(docs: DataFrame) -> DataFrame:
    """Slim rows: grp (a key that orders sources: null first, then by bytes), key, doc_id, digest, told (the digest after tampering)."""
    even = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    own = docs.select("doc_id", "source", "lang", "n_chars", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(F.encode(F.col("source").cast("string"), "UTF-8")))).alias("grp"),
        leaf(F.col("text")).alias("digest"),
        F.when(even, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    # null doc_ids first; rows of one doc_id by digest, equal ones as they were read
    place = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.when(F.col("doc_id").isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), place)), "digest", F.lpad(F.hex("row"), 16, "0"))
    return own.select("grp", key.alias("key"), "doc_id", "digest", F.coalesce("changed", "digest").alias("told"))


def _trees(docs: DataFrame, fanout: int, levels: int, bucket: int):
    """Tiers of the sources' trees, subroots (grp, key, digest), tiers of the tree over them, and its root (None: no rows)."""
    rows = ranked(materialize(_leaves(docs), "leaves"), bucket).drop("key")
    tiers, subroots = climb(rows, fanout, levels)
    subroots = materialize(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest"), "subroots")
    top_tiers, top = climb(ranked(subroots, bucket), fanout, levels)
    root = top.first()
    return tiers, subroots, top_tiers, root and root["digest"]


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, bucket: int = BUCKET) -> DataFrame:
    """One row per source: source, rows, subroot, root. What two copies of a dataset compare first. No rows: no rows."""
    tiers, subroots, _, root = _trees(docs, fanout, levels, bucket)
    sizes = tiers[0].groupBy("grp").agg(F.sum(F.size("nodes")).cast("long").alias("rows"))
    source = F.when(F.col("grp") == "0", F.lit(None).cast("string")).otherwise(F.decode(F.unhex(F.substring("grp", 2, 1 << 30)), "UTF-8"))
    own = subroots.select(F.col("key").alias("grp"), F.col("digest").alias("subroot"))
    return own.join(sizes, "grp").select(source.alias("source"), "rows", "subroot", F.lit(root).cast("string").alias("root"))


def proofs(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text (null: `-`). Leaves of a source ascend by doc_id (null
    first, rows of one doc_id by digest); runs of `fanout` nodes become one until one is left, also runs of one node.
    Sources, null first, go on likewise. Rows whose doc_id has an even crc32 have the line ends of their text deleted
    before they are verified (a null doc_id is left as it is, as are texts without line ends). No documents: no rows.
    """
    tiers, subroots, top_tiers, root = _trees(docs, fanout, levels, bucket)
    if root is None:
        return docs.sparkSession.createDataFrame([], _PROOF)
    start = subroots.limit(1).select("grp", F.array().cast(_PATH).alias("path"))
    over = descend(top_tiers, start, fanout, levels).withColumn("digests", F.col("nodes.digest"))
    keys = over.select("block", F.posexplode("nodes.key").alias("i", "key")).select((F.col("block") * fanout**levels + F.col("i")).alias("rank"), "key")
    at = node_paths(over, [], f"grp string, rank long, path {_PATH}", fanout, levels)
    tops = subroots.join(keys.join(at.drop("grp"), "rank"), "key").select(F.col("key").alias("grp"), "path", F.col("digest").alias("subroot"))
    blocks = descend(tiers, materialize(tops, "tops"), fanout, levels)

    def tasks(batches):
        for b in batches:
            for i in range(b.num_rows):
                total, ids, digests, told, path, subroot = (b.column(k)[i] for k in range(6))
                digests, told, own = digests.as_py(), told.as_py(), subroot.as_py()
                nodes = reduce_levels(digests, _block_levels(total.as_py(), fanout, levels), fanout)
                upper = [(x["place"], x["others"]) for x in path.as_py()]
                above = "".join(s for _, others in upper for s in others)
                proof, folded = [], []
                for k, digest in enumerate(told):
                    lower = _paths(nodes, k, fanout)
                    proof.append(sha([*(s for _, others in lower for s in others), above]))
                    folded.append(fold(digest, lower + upper))
                n = len(digests)
                columns = [ids.values, digests, [own] * n, [root] * n, proof, folded, [x == root for x in folded]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    kinds, names = [pa.int64(), *[pa.string()] * 5, pa.bool_()], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return map_batches(blocks.select("total", "nodes.doc_id", "nodes.digest", "nodes.told", "path", "subroot"), tasks, _PROOF)


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
