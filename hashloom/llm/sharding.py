"""Sharding by balanced label propagation.

Documents are linked through hubs (here: the digest of an equal text), never pair by pair. Each round a hub counts
its documents' shards and asks for the commonest one that has room for the rest of the hub; each shard admits as many
bytes of linked documents as its quota allows. A last pass levels the sizes with documents that have no links first.
Every order that a quota needs is a running sum in two steps, over small slices of a shard, so no task ever holds a
whole shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, texts_of

#: Rounds at most; rows of a slice at most, and slices that all rows make at least; documents that the driver places one by one at most.
ROUNDS, SLICE, SLICES, LARGE = 4, 5000, 2048, 16_000

COLUMNS = ("row", "hub", "m", "fan", "size", "doc_id", "crc")


def running(rows: DataFrame, keys: list[str], slice_of: Column, order: list, amount: Column, name: str) -> DataFrame:
    """rows with the sum of amount over earlier rows of their keys: by slice, then by order within the slice."""
    rows = rows.withColumn("_slice", slice_of)
    totals = rows.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*keys, "_slice", before.alias("_before"))
    own = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(starts, [*keys, "_slice"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_slice", "_before", "_own")


def by_hub(slices: int) -> Column:
    """Slice of a row: linked documents first, by their hub, so that a hub's rows lie together; a large hub takes several slices in a row."""
    linked = F.pmod(F.xxhash64("hub"), F.lit(slices)) * (1 << 24) + F.pmod(F.xxhash64("row"), F.col("fan"))
    return F.when(F.col("m") > 1, linked).otherwise((1 << 60) + F.pmod(F.xxhash64("doc_id", "hub"), F.lit(slices)))


def loads(rows: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["s"] for r in rows.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    return [found.get(k, 0) for k in range(shards)]


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), place + 1)


def propagate(linked: DataFrame, shards: int, quota: float, slices: int) -> tuple[DataFrame, bool]:
    """One round over linked documents: (documents with their shards after it, whether any asked to move).

    A hub that lies in several shards asks for the one with most of its documents (the lowest of equals) among those
    that have room for the rest of it; failing those, for the roomiest shard if the whole hub fits there; a hub that
    fits nowhere asks for its commonest shard with any room. A shard admits rows in order, hub by hub, up to its room.
    """
    votes = materialize(linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "votes")
    # documents away from their hub's commonest shard are about to leave, so their bytes are room
    home = votes.groupBy("hub").agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"), "bytes")).alias("v")).select((-F.col("v.minus")).alias("shard"), F.col("v.bytes").alias("size"))
    room = [max(0, int(quota - b)) for b in loads(home, shards)]
    best = max(range(shards), key=lambda k: (room[k], -k))
    hubs = votes.groupBy("hub").agg(F.collect_list(F.struct("n", (-F.col("shard")).alias("minus"), "bytes")).alias("votes"), F.sum("bytes").alias("bytes")).filter(F.size("votes") > 1)  # a hub has `shards` votes at most
    fits = F.array_max(F.filter("votes", lambda v: _at(room, -v["minus"]) >= F.col("bytes") - v["bytes"]))
    some = F.array_max(F.filter("votes", lambda v: _at(room, -v["minus"]) > 0))
    want = F.coalesce(-fits["minus"], F.when(F.lit(room[best]) >= F.col("bytes"), F.lit(best)), -some["minus"])
    wanted = materialize(hubs.select("hub", want.cast("int").alias("want")).filter("want IS NOT NULL"), "wanted")
    if wanted.isEmpty():
        return linked, False
    asked = linked.join(wanted, "hub", "left")
    asked = materialize(asked.withColumn("want", F.coalesce("want", "shard")), "asked")
    movers = running(asked.filter("want <> shard"), ["want"], by_hub(slices), ["hub", "doc_id", "row"], F.col("size"), "asked_before")
    moved = movers.select(*COLUMNS, F.when(F.col("asked_before") + F.col("size") <= _at(room, F.col("want")), F.col("want")).otherwise(F.col("shard")).cast("int").alias("shard"))
    out = materialize(asked.filter("want = shard").select(*COLUMNS, "shard").unionByName(moved), "moved")
    discard(votes, wanted, asked, linked)
    return out, True


def level(rows: DataFrame, shards: int, slices: int, large: int = LARGE) -> DataFrame:
    """Make sizes near equal: large documents are placed one by one, the rest of a shard's surplus fills the others' room in order.

    A document is large if it has over 1/large of all bytes, so there are fewer than `large` of them, and what the
    order places without looking at single documents is off by no more than one of the others. Both steps run at
    every size of input. Linked documents stay before others do, and large ones move with their hub while it fits.
    """
    total = sum(loads(rows, shards))
    cut, mean = total // large, -(-total // shards)
    heavy, rest = rows.filter(F.col("size") > cut), rows.filter(F.col("size") <= cut)
    held, units, alone, placed = loads(rest.filter("m > 1"), shards), {}, [], {}
    for r in sorted(heavy.select("row", "hub", "doc_id", "m", "size", "shard").collect(), key=lambda r: (r["hub"], r["doc_id"] is not None, r["doc_id"], r["row"])):
        units.setdefault((r["hub"], r["shard"]), []).append(r) if r["m"] > 1 else alone.append(r)
    weight, left = {u: sum(r["size"] for r in own) for u, own in units.items()}, []
    for u in sorted(units, key=lambda u: (-weight[u], u)):
        if held[u[1]] + weight[u] <= mean:
            held[u[1]] += weight[u]
        else:
            left.append(u)
    for u in left:  # whole to the emptiest shard, or one by one where it fits nowhere
        k = min(range(shards), key=lambda k: (held[k], k))
        if held[k] + weight[u] <= mean:
            placed |= {r["row"]: k for r in units[u]}
            held[k] += weight[u]
        else:
            alone += units[u]
    homeless = []
    for r in sorted(alone, key=lambda r: (-r["size"], r["hub"])):
        if r["m"] < 2 and held[r["shard"]] + r["size"] <= mean:
            held[r["shard"]] += r["size"]
        else:
            homeless.append(r)
    heap = [(b, k) for k, b in enumerate(held)]
    heapq.heapify(heap)
    for r in homeless:
        b, k = heapq.heappop(heap)
        placed[r["row"]] = k
        held[k] = b + r["size"]
        heapq.heappush(heap, (held[k], k))
    light = materialize(running(rest, ["shard"], by_hub(slices), ["hub", "doc_id", "row"], F.col("size"), "before"), "light")
    now, linked = loads(light, shards), loads(light.filter("m > 1"), shards)
    room = [max(0, mean - h + own) for h, own in zip(held, linked, strict=True)]
    scale = sum(now) / max(1, sum(room))
    room = [int(r * scale) for r in room]
    # what a shard has beyond its room lies in one line of surplus bytes; gaps of the others are cut from that line
    surplus = [max(0, n - r) for n, r in zip(now, room, strict=True)]
    starts = [sum(surplus[:k]) for k in range(shards)]
    gaps, at = [], 0
    for k in range(shards):
        if room[k] > now[k]:
            at += room[k] - now[k]
            gaps.append((at, k))
    limit = _at(room, F.col("shard"))
    target = F.lit(gaps[-1][1] if gaps else 0)
    for end, k in reversed(gaps):
        target = F.when(F.col("_place") < end, F.lit(k)).otherwise(target)
    over = F.col("before") >= limit
    moved = light.withColumn("_place", _at(starts, F.col("shard")) + F.col("before") - limit).withColumn("shard", F.when(over & F.lit(bool(gaps)), target).otherwise(F.col("shard")).cast("int"))
    if placed:
        moves = rows.sparkSession.createDataFrame(list(placed.items()), "row long, to int")  # fewer than `large`
        heavy = heavy.join(F.broadcast(moves), "row", "left").withColumn("shard", F.coalesce("to", "shard"))
    out = materialize(moved.select(*COLUMNS, "shard").unionByName(heavy.select(*COLUMNS, "shard")), "level")
    discard(light)
    return out


def assign(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS, large: int = LARGE) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, cut (has another shard than its hub's commonest).

    The law is `bytes`: sizes (UTF-8 bytes plus one) near equal. Equal texts are linked; null and empty texts count
    as one byte and are linked to each other. Repeated rows are placed one by one. Slots number a shard's rows from
    0 without gaps. No documents: no rows. Places depend on doc_id and text; only within a hub of more rows than a
    slice has, and among null or repeated doc_ids, does the order of files pick which rows share a shard.
    """
    data = F.encode("text", "UTF-8")
    rows = texts_of(docs).select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("crc"), F.unhex(F.sha2(data, 256)).alias("hub"))
    sized = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "sized")
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    slice_rows = min(SLICE, max(64, n // SLICES))
    slices = max(16, -(-n // (shards * slice_rows)))
    groups = materialize(sized.groupBy("hub").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "groups")
    start = F.pmod(F.xxhash64("doc_id", "hub"), F.lit(shards)).cast("int")
    rows = sized.join(groups, "hub", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("fan", F.floor(F.col("m") / slice_rows) + 1)
    rows = materialize(rows.select(*COLUMNS, start.alias("shard")), "started")
    linked, more = materialize(rows.filter("m > 1"), "linked"), True
    while more and rounds:
        linked, more = propagate(linked, shards, total / shards, slices)
        rounds -= 1
    now = level(rows.filter("m = 1").unionByName(linked), shards, slices, large)
    discard(sized, rows)
    votes = now.filter("m > 1").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("hub").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("home"))
    apart = F.pmod(F.xxhash64("doc_id", "hub", F.when(F.col("fan") > 1, F.col("row"))), F.lit(slices))
    slotted = running(now, ["shard"], apart, ["doc_id", "hub", "row"], F.lit(1), "slot")
    out = slotted.join(materialize(votes, "homes"), "hub", "left")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce(F.col("home") != F.col("shard"), F.lit(False)).alias("cut"))
