"""Shards of even size that keep linked documents together, by balanced label propagation in built-in functions.

Documents are linked through hubs (here: equal texts), so a group of n documents has n links and not n * n. Linked
documents start in the shard of their hash. In each round a document looks at the shards of its neighbours and wants
the one that holds most of them and has room; of those that want a shard, hash thresholds let in as many bytes as fit.
Documents without links feel no pull and fill what is left, so sizes come out even without cutting a link.

Only histograms of a fixed number of cells, and the few documents above a thousandth of a shard, reach the driver.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from optelem.plans.lookups import settle, settled_lookup

CELLS = 4096  # of a histogram
CELL_BITS = 12
LEAST_ROOM = 0.01  # of a shard; one with less counts as full
BIG_SHARE = 1000  # a document above mean / BIG_SHARE is placed singly; there are at most shards * BIG_SHARE of them


def _cell(level: int = 0) -> Column:
    return F.shiftrightunsigned("_h", 64 - CELL_BITS * (level + 1)).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _by_shard(values: list, shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard + 1)


def _loads(placed: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["bytes"] for r in placed.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _admitted(movers: DataFrame, to: str, room: list[int]) -> list[int]:
    """Per shard the first hash cell that no longer fits into its room."""
    cells = movers.groupBy(to, _cell().alias("_c")).agg(F.sum("size").alias("_s")).collect()
    limits = [CELLS] * len(room)
    for shard in range(len(room)):
        taken = 0
        for cell, size in sorted((r["_c"], r["_s"]) for r in cells if r[to] == shard):
            taken += size
            if taken > room[shard]:
                limits[shard] = cell
                break
    return limits


def propagate(nodes: DataFrame, links: DataFrame, shards: int, room: list[float], rounds: int = 8) -> DataFrame:
    """node, size, _h, shard of linked `nodes` (node, size, _h): label propagation over `links` (node, hub) under quotas.

    Ties go to the lower shard. A shard lets in, per round, no more bytes than its room at the start of the round.
    """
    placed = settle(nodes.select("node", "size", "_h", F.pmod(F.xxhash64("_h"), F.lit(shards)).cast("int").alias("shard")))
    for _ in range(rounds):
        loads = _loads(placed, shards)
        free = [int(r - x) if r - x > LEAST_ROOM * r else 0 for r, x in zip(room, loads)]
        here = links.join(placed.select("node", "shard"), "node")
        counts = settled_lookup(here.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("_n")))  # apart from the join, which can then split a hot hub
        pulls = here.select("node", "hub", F.col("shard").alias("_own")).join(counts, "hub")
        pulls = pulls.where((F.col("shard") == F.col("_own")) | (_by_shard(free, F.col("shard")) > 0))
        best = (pulls.groupBy("node", "shard").agg(F.sum("_n").alias("_n")).groupBy("node")
                .agg(F.max(F.struct("_n", (-F.col("shard")).alias("_minus"))).alias("_best")).select("node", (-F.col("_best._minus")).alias("_to")))
        wanted = settle(placed.join(best, "node", "left"))
        movers = wanted.where("_to <> shard")
        limits = _admitted(movers, "_to", free)
        let_in = (F.col("_to") != F.col("shard")) & (_cell() < _by_shard(limits, F.col("_to")))
        placed = wanted.withColumn("_in", F.coalesce(let_in, F.lit(False)))
        moved = placed.where("_in").limit(1).count()
        placed = placed.select("node", "size", "_h", F.when(F.col("_in"), F.col("_to")).otherwise(F.col("shard")).alias("shard"))
        if not moved:
            break
    return placed


def _released(placed: DataFrame, shards: int, room: list[float]) -> DataFrame:
    """`placed` with the shard taken from those that are above the room of their shard, by hash cell."""
    limits = _admitted(placed, "shard", [int(r) for r in room])
    return placed.withColumn("shard", F.when(_cell() < _by_shard(limits, F.col("shard")), F.col("shard")))


def _filled(free: DataFrame, need: list[float]) -> Column:
    """Shard of each row of `free`, as a column over `_h`: rows are dealt in order of cells, each shard as many bytes as it needs.

    A bound between two shards lies in a cell; the cells that hold one are divided once more, and the bound is set
    between two of the parts.
    """
    bounds = list(accumulate(need))[:-1]
    sums = {r["_c"]: r["_s"] for r in free.groupBy(_cell().alias("_c")).agg(F.sum("size").alias("_s")).collect()}
    ends = list(accumulate(sums.get(c, 0) for c in range(CELLS)))
    cut = [bisect_left(ends, b) for b in bounds]
    inner = free.where(_cell().isin(sorted(set(cut)))).groupBy(_cell().alias("_c"), _cell(1).alias("_d")).agg(F.sum("size").alias("_s")).collect()
    parts: dict[int, list[int]] = {c: [0] * CELLS for c in cut}
    for r in inner:
        parts[r["_c"]][r["_d"]] = r["_s"]
    place, shard = _cell() * CELLS + _cell(1), F.lit(0)
    for c, bound in zip(cut, bounds):
        starts = [0, *accumulate(parts[c])]
        inside = bisect_left(starts, bound - (ends[c - 1] if c else 0)) if c < CELLS else 0
        shard = shard + F.when(place >= c * CELLS + inside, 1).otherwise(0)
    return shard


def assign(nodes: DataFrame, links: DataFrame, shards: int = 16, rounds: int = 8) -> DataFrame:
    """node, shard of `nodes` (node long, size long): even sums of size, links (node, hub) kept inside shards as far as they fit.

    `links` may name hubs with one node, and nodes in several hubs. A hub larger than a shard is cut; so is nothing
    else while there is room. Sizes differ by about the largest document or a thousandth of a shard. An empty table
    has no shards. A column `key` (long) of `nodes` stands for the node wherever the result depends on it, so that it
    does not depend on how nodes are numbered.
    """
    key = "key" if "key" in nodes.columns else "node"
    hashed = settle(nodes.select("node", "size", F.col(key).alias("_key"), F.xxhash64(key, "size").alias("_h")))
    total = hashed.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    room = [mean] * shards
    shared = settled_lookup(links.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hub"))
    real = settle(links.join(shared, "hub").select("node", "hub"))
    bound = hashed.join(real.select("node").distinct(), "node", "left_semi")
    placed = settle(_released(propagate(bound, real, shards, room, rounds), shards, room))
    loose = settle(hashed.join(placed.where("shard IS NOT NULL").select("node"), "node", "left_anti"))
    loads = _loads(placed, shards)
    big = loose.where(F.col("size") * BIG_SHARE > mean).select("node", "size", "_key").collect()
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    single = []
    for _, _, node, size in sorted((-r["size"], r["_key"], r["node"], r["size"]) for r in big):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
        single.append((node, s))
    loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
    rest = loose.where(F.col("size") * BIG_SHARE <= mean)
    over = max(0.0, sum(max(0.0, x - mean) for x in loads))
    need = [max(0.0, mean - x) for x in loads]
    need = [n * (1 - over / sum(need)) if sum(need) else 0.0 for n in need]
    filled = rest.select("node", _filled(rest, need).cast("int").alias("shard"))
    told = F.from_json(F.lit(json.dumps([{"node": node, "shard": s} for node, s in single])), "array<struct<node: bigint, shard: int>>")
    singles = nodes.sparkSession.range(1).select(F.inline(told))
    return placed.where("shard IS NOT NULL").select("node", "shard").unionByName(singles).unionByName(filled)


def slots(placed: DataFrame, shards: int) -> DataFrame:
    """`placed` (node, shard, ...) with `slot`, gapless from 0 in each shard; rows are numbered within hash cells, after the rows of earlier cells.

    As in `assign`, a column `key` decides in place of the node.
    """
    key = "key" if "key" in placed.columns else "node"
    dealt = placed.withColumn("_h", F.xxhash64(key, "shard")).withColumn("_c", _cell())
    counts = dealt.groupBy("shard", "_c").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(counts.select("shard", "_c", F.coalesce(before, F.lit(0)).alias("_before")))  # at most shards * CELLS rows
    number = F.row_number().over(Window.partitionBy("shard", "_c").orderBy("_h", key, "node")) - 1
    return dealt.join(offsets, ["shard", "_c"]).withColumn("slot", (F.col("_before") + number).cast("long")).drop("_h", "_c", "_before")


def shard_rows(df: DataFrame, row_id: str = "doc_id", text: str = "text", shards: int = 16, rounds: int = 8) -> DataFrame:
    """row_id, size, text_crc32, law, shard, slot, grown_shard of every row of `df`, linked through equal texts.

    The size is the text's UTF-8 bytes plus 1; a NULL text counts as empty. Repeated rows are rows of their own and
    linked like other copies, NULL ids are kept. Law `bytes` holds, so `grown_shard` is NULL. A row's place follows from
    its id, its text and its number among rows that have both alike, not from the partition that it is read from.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    shaped = df.select(F.col(row_id).alias("_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("hub"))
    counted = shaped.groupBy("_id", "size", "text_crc32", "hub").agg(F.count(F.lit(1)).alias("_copies"))
    each = counted.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).withColumn("key", F.xxhash64("_id", F.col("_id").isNull(), "hub", "_nth"))
    rows = settle(each.drop("_copies", "_nth").withColumn("node", F.monotonically_increasing_id()))
    assigned = assign(rows.select("node", "size", "key"), rows.select("node", "hub"), shards, rounds)
    placed = slots(assigned.join(rows.select("node", "key"), "node"), shards).select("node", "shard", "slot")
    return rows.join(placed, "node").select(F.col("_id").alias(row_id), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                            F.lit(None).cast("int").alias("grown_shard"))
