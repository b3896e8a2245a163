"""Sharding by balanced label propagation.

Linked documents, here those with equal texts, start in shards dealt by a hash. In each
round a join tells every one of them how many of its neighbours are in which shard; those
that have more in another shard with room apply to move there, and of the applications to
a shard as many are granted, best gains first, as its quota of bytes allows. Rounds move
documents to shards of lower and of higher numbers in turn, so that neighbours do not pass each
other, until neither moves any. Afterwards what exceeds a shard's share is released, by whole
links but for one, and, with the documents that have no links, fills the shards to equal sizes:
the large ones first, then the small ones level what is uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kolophon.runtime import Scratch, with_global_index

#: Shards, and a guard on rounds; they end by themselves when nothing moves.
SHARDS, ROUNDS = 8, 40
#: Applications of which a smaller part than this would be granted are refused.
LEAST_GRANT = 0.01
#: A shard may be so much fuller than its share while labels move.
SLACK = 1.02
#: The smallest documents, which hold about this share of what is free, level the shards.
LEVELLING = 0.1


def _votes(members: DataFrame, labels: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """For each node (id, shard, size, v): by shard, its neighbours there, itself left out."""
    at = members.join(labels.select("id", "shard"), "id")
    # Written first, so that both sides of the next join are plain shuffles and a hot link's can be split.
    count = scratch.save(at.groupBy("link").agg(*[F.sum(F.when(F.col("shard") == i, 1).otherwise(0)).alias(f"c{i}") for i in range(n)]), "count")
    own = at.join(count, "link").select("id", *[(F.col(f"c{i}") - F.when(F.col("shard") == i, 1).otherwise(0)).alias(f"c{i}") for i in range(n)])
    sums = own.groupBy("id").agg(F.array(*[F.sum(f"c{i}") for i in range(n)]).alias("v"))
    return labels.join(sums, "id")


def propagate(nodes: DataFrame, members: DataFrame, capacity: float, scratch: Scratch, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(id, size, shard)`` for ``nodes(id, size)``, linked by common ``link`` in ``members(id, link)``.

    A link may have any number of members; no pairs of them are made. ``capacity`` is the
    bytes that a shard may hold. Only sums by shard and gain come to the driver.
    """
    labels = scratch.save(nodes.select("id", "size", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int").alias("shard")), "labels")
    still = 0
    for turn in range(rounds):
        load = dict(labels.groupBy("shard").agg(F.sum("size")).collect())
        room = [capacity - (load.get(i) or 0) for i in range(n)]
        votes = _votes(members, labels, n, scratch)
        options = F.array(*[F.struct(F.col("v")[i].alias("v"), F.lit(-i).alias("i")) for i in range(n) if room[i] > 0])
        best = F.array_max(options) if any(r > 0 for r in room) else F.lit(None).cast("struct<v:bigint,i:int>")
        free = -F.col("best.i") < F.col("shard") if turn % 2 == 0 else -F.col("best.i") > F.col("shard")
        gain = F.col("best.v") - F.element_at("v", F.col("shard") + 1)
        apply = votes.withColumn("best", best).select("id", "size", "shard", F.when(free & (gain > 0), -F.col("best.i")).alias("to"), F.floor(F.log2(gain.cast("double"))).alias("level"))
        apply = scratch.save(apply, "applications")
        asked = apply.where("to IS NOT NULL").groupBy("to", "level").agg(F.sum("size").alias("size")).orderBy(F.desc("level")).collect()
        grants: dict[tuple[int, int], float] = {}
        for to, level, size in asked:
            share = min(1.0, max(0.0, room[to]) / size)
            share = share if share >= LEAST_GRANT else 0.0
            grants[to, level] = share
            room[to] -= share * size
        if not any(grants.values()):
            scratch.drop(apply)
            still += 1
            if still == 2:  # neither to lower nor to higher numbers
                break
            continue
        still = 0
        granted = F.lit(0.0)
        for (to, level), share in grants.items():
            granted = F.when((F.col("to") == to) & (F.col("level") == level), share).otherwise(granted)
        draw = F.pmod(F.xxhash64("id", F.lit(200 + turn)), F.lit(1 << 30)) / float(1 << 30)
        moved = scratch.save(apply.select("id", "size", F.when(F.col("to").isNotNull() & (draw < granted), F.col("to")).otherwise(F.col("shard")).cast("int").alias("shard")), "labels")
        scratch.drop(apply, labels)
        labels = moved
    return labels


def _fill(scratch: Scratch, pool: DataFrame, lacking: list[float]) -> DataFrame:
    """Deal ``pool(id, size)`` in proportion to what shards lack, by running sums in hash order."""
    lacking = [max(0.0, x) for x in lacking]
    total = float(pool.agg(F.sum("size")).first()[0] or 0)
    whole = sum(lacking) or 1.0
    ranked = with_global_index(scratch, pool, [F.xxhash64("id", F.lit(5)), F.col("id")], weight="size")
    middle = F.col("weight_before") + F.col("size") / 2
    shard, end = F.lit(max(range(len(lacking)), key=lambda i: lacking[i])), total
    for i in reversed(range(len(lacking))):
        if lacking[i]:
            start = end - lacking[i] / whole * total
            shard = F.when(middle >= start, F.when(middle < end, i).otherwise(shard)).otherwise(shard)
            end = start
    return ranked.select("id", "size", shard.cast("int").alias("shard"))


def balanced_shards(nodes: DataFrame, members: DataFrame, scratch: Scratch, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``(id, size, shard)`` with sizes near equal and few links across shards."""
    total = float(nodes.agg(F.sum("size")).first()[0] or 0)
    share = total / n
    linked = nodes.join(members.select("id").distinct(), "id", "left_semi")
    labels = propagate(linked, members, share * SLACK, scratch, n, rounds)
    # Released: what lies beyond a shard's share, from the end of an order by links.
    linked = labels.join(members.groupBy("id").agg(F.min(F.xxhash64("link")).alias("first")), "id")
    ranked = scratch.save(with_global_index(scratch, linked, [F.col("first"), F.col("id")], group="shard", weight="size"), "ranked")
    inside = F.col("weight_before") + F.col("size") <= share
    kept = ranked.where(inside).select("id", "size", "shard")
    single = nodes.join(members.select("id").distinct(), "id", "left_anti").select("id", "size")
    pool = scratch.save(ranked.where(~inside).select("id", "size").unionByName(single), "pool")

    # Classes of size by powers of two; the smallest of them level the shards.
    classes = sorted((int(r.c), float(r.s)) for r in pool.groupBy(F.floor(F.log2("size")).alias("c")).agg(F.sum("size").alias("s")).collect())
    cut, below, free = 0, 0.0, sum(s for _, s in classes)
    for c, s in classes:
        if below >= LEVELLING * free:
            break
        cut, below = c + 1, below + s
    placed = kept
    for part in (pool.where(F.col("size") >= 2**cut), pool.where(F.col("size") < 2**cut)):
        load = dict(placed.groupBy("shard").agg(F.sum("size")).collect())
        placed = scratch.save(placed.unionByName(_fill(scratch, part, [share - (load.get(i) or 0) for i in range(n)])), "placed")
    return placed


def shard_documents(docs: DataFrame, n: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Put documents into shards 0 to n - 1, near equal in bytes, equal texts together where they fit.

    ``docs`` has ``doc_id`` (long) and ``text``; other columns are ignored. Size: UTF-8 bytes of
    the text (a null has none) plus 1. Returns a row per row of ``docs``: doc_id, size,
    text_crc32 (of a null text: of no bytes), law (`bytes`), shard, slot (gapless from 0 in a
    shard, by doc_id with null first), grown_shard (null under this law). Null texts are equal to
    empty ones. Rows that repeat are documents of their own. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    raw = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("t"),
        F.xxhash64(F.concat(F.lit("\x01"), raw)).alias("t2"),  # from other words than t, so no function of it
    )
    base = scratch.save(base, "base")
    link = F.struct("t", "t2").alias("link")
    # Written first, so that both sides of the join are plain shuffles and a hot key's can be split.
    several = scratch.save(base.groupBy("t", "t2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "several")
    members = scratch.save(base.join(several, ["t", "t2"], "left_semi").select("id", link), "members")
    placed = balanced_shards(base.select("id", "size"), members, scratch, n, rounds)
    whole = base.select("id", "doc_id", "size", "text_crc32").join(placed.select("id", "shard"), "id")
    ranked = with_global_index(scratch, whole, [F.col("doc_id").asc_nulls_first(), F.col("id")], group="shard", index="slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
