"""Sharding by fixed virtual slots.

A record belongs to one of ``slots`` virtual slots for ever (a hash of its key). Shards own slots, by
a map that is stored with a version number. Version 1 deals the slots out in turn. Bytes are summed
per slot, and rebalancing writes the next version: an edit moves single slots from the fullest to the
emptiest shard until no move helps, so every other slot stays where it was. Records are never moved
one by one, and the map has ``slots`` rows however large the table is. ``save_map``, ``load_map``, ``edit_map`` and
``shard_by`` keep that map over the life of a table: version 3 edits version 2, whatever the table has become.

Null texts count one byte (none, plus one) and null keys hash as zero. Repeated rows are records of
their own. An empty table gives an empty result and a map without edits. Extra columns are not read.
"""

import heapq

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawfield.llm.common import query, stored, table

SLOTS = 8192
SHARDS = 16


def measured(docs, slots=SLOTS):
    """Narrow rows: the key, its size, the checksum of the text and its virtual slot."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # Equal keys with different texts may part: a repeated key does not pile up in one slot.
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), text), F.lit(slots))
        .cast("int").alias("virtual_slot"))


def rebalance(owner, weight, shards):
    """Edits ``(slot, from, to)`` that even out the weights. ``owner``, ``weight``: by slot.

    Each step takes the fullest shard and gives the emptiest the largest slot that still shrinks the
    gap between the two; at the end, slots of the two are exchanged where that shrinks it further.
    """
    loads, owned = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        loads[shard] += weight[slot]
        if weight[slot]:
            owned[shard].append((weight[slot], slot))
    for slots in owned:
        slots.sort()
    now = dict(enumerate(owner))

    def move(item, a, b):
        owned[a].remove(item)
        heapq.heappush(owned[b], item)
        owned[b].sort()
        loads[a] -= item[0]
        loads[b] += item[0]
        now[item[1]] = b

    for _ in range(4 * len(owner) + 64):
        a, b = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
        gap = loads[a] - loads[b]
        fits = [x for x in owned[a] if x[0] < gap]
        best = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]), default=None)
        swap = None
        if best is None or abs(gap - 2 * best[0]) > gap // 2:
            pairs = ((abs(gap - 2 * (x[0] - y[0])), x, y) for x in owned[a][-64:] for y in owned[b][-64:]
                     if 0 < x[0] - y[0] < gap)
            swap = min(pairs, default=None)
        if best is None and swap is None:
            break
        if swap is not None and (best is None or swap[0] < abs(gap - 2 * best[0])):
            move(swap[1], a, b)
            move(swap[2], b, a)
        else:
            move(best, a, b)
    return [(slot, owner[slot], now[slot]) for slot in range(len(owner)) if owner[slot] != now[slot]]


def slot_map(rows, shards=SHARDS, slots=SLOTS):
    """The stored map, all versions: ``version``, ``virtual_slot``, ``shard``, ``slot_rows``,
    ``slot_bytes``, ``first`` (records of the shard in its slots before this one)."""
    spark = rows.sparkSession
    found = {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot")
             .agg(F.count(F.lit(1)), F.sum("size")).collect()}  # at most ``slots`` rows
    count = [found.get(s, (0, 0))[0] for s in range(slots)]
    weight = [found.get(s, (0, 0))[1] for s in range(slots)]
    first_map = [s % shards for s in range(slots)]
    second = list(first_map)
    for slot, _, to in rebalance(first_map, weight, shards):
        second[slot] = to
    versions = []
    for version, owner in ((1, first_map), (2, second)):
        before = [0] * shards
        for slot, shard in enumerate(owner):
            versions.append((version, slot, shard, count[slot], weight[slot], before[shard]))
            before[shard] += count[slot]
    return stored(spark.createDataFrame(versions, "version int, virtual_slot int, shard int, slot_rows long, "
                                                  "slot_bytes long, first long").coalesce(1), "slot-map")


def _placed(rows, latest):
    # The map has ``slots`` rows: a fixed size.
    owned = rows.join(F.broadcast(latest.select("virtual_slot", "shard", "first")), "virtual_slot")
    inside = F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return owned.withColumn("place", F.col("first") + inside - 1)


def shard(docs, shards=SHARDS, slots=SLOTS):
    """``(rows, map)``: every record with its shard and place, and the versioned map behind it.

    ``place`` counts a shard's records from 0: slot after slot, by key within a slot. Numbering needs
    one slot's narrow rows at a time, never a whole shard's.
    """
    rows = measured(docs, slots)
    maps = slot_map(rows, shards, slots)
    latest = maps.filter(F.col("version") == maps.agg(F.max("version")).first()[0])
    return _placed(rows, latest), maps


# --- the stored map over the life of a table -----------------------------------------------

def save_map(maps, path):
    """Store each version of a map as a folder of its own; a version that is there already is an error, never replaced."""
    for version in sorted(r[0] for r in maps.select("version").distinct().collect()):
        maps.filter(F.col("version") == version).drop("version").coalesce(1).write.mode("errorifexists").parquet(
            f"{path}/version={version}")
    return path


def load_map(spark, path, version=None):
    """One stored version, the newest by default: ``version`` and what :func:`slot_map` lists for its slots."""
    maps = spark.read.parquet(path).withColumn("version", F.col("version").cast("int"))
    wanted = maps.agg(F.max("version")).first()[0] if version is None else version
    found = maps.filter(F.col("version") == wanted)
    rows, low, high, different = found.agg(F.count(F.lit(1)), F.min("virtual_slot"), F.max("virtual_slot"),
                                           F.count_distinct("virtual_slot")).first()
    if not rows or (low, high, different) != (0, rows - 1, rows):
        raise ValueError(f"version {wanted} of the map is missing or does not name each slot once")
    return found


def edit_map(current, docs, shards=None):
    """``(next version, edits)`` from the version ``current`` and the table as it is now.

    Slots stay with their shards but for the edits ``(slot, from, to)``, which even out today's bytes. ``shards`` may
    be larger than before: the new shards start empty and take slots by edits alone. A smaller number is an
    error where a slot would lose its shard. Only ``slots`` sums come to the driver.
    """
    spark = docs.sparkSession
    held = sorted(current.select("virtual_slot", "shard", "version").collect())
    owner, slots = [r["shard"] for r in held], len(held)
    shards = max(owner) + 1 if shards is None else shards
    if shards <= max(owner):
        raise ValueError(f"slots belong to shard {max(owner)}, beyond {shards} shards")
    found = {r[0]: (r[1], r[2]) for r in measured(docs, slots).groupBy("virtual_slot")
             .agg(F.count(F.lit(1)), F.sum("size")).collect()}
    edits = rebalance(owner, [found.get(s, (0, 0))[1] for s in range(slots)], shards)
    for slot, _, to in edits:
        owner[slot] = to
    before, rows = [0] * shards, []
    for slot, mine in enumerate(owner):
        count, size = found.get(slot, (0, 0))
        rows.append((held[0]["version"] + 1, slot, mine, count, size, before[mine]))
        before[mine] += count
    return stored(spark.createDataFrame(rows, "version int, virtual_slot int, shard int, slot_rows long, slot_bytes long, "
                                              "first long").coalesce(1), "slot-map"), edits


def shard_by(docs, version):
    """Every record with its shard and place by one version of the map, which must be of this very table.

    A table that has grown since has other counts a slot, so its places would collide: that is an error. Take
    :func:`edit_map` first.
    """
    rows = measured(docs, version.count())
    counts = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("now"))
    if version.join(counts, "virtual_slot", "left").filter(F.coalesce("now", F.lit(0)) != F.col("slot_rows")).limit(1).count():
        raise ValueError("the map was made for other rows: edit it first")
    return _placed(rows, version)


@query("op5_sharding")
def op5_sharding(spark, sf_dir):
    rows, _ = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                       "virtual_slot", F.lit(2).alias("map_version"))
