"""Near duplicates by circulant MinHash, bands, and exact Jaccard verification on whole sets.

A document's set holds its distinct ``words``-word shingles (the whole sequence where there are fewer words). Two
documents link when ``100 * |A & B| >= percent * |A | B|``; the result is the links' components.

1. *Signature.* Two fixed permutations of ``UNIVERSE`` places do for all coordinates. The first takes a shingle's
   bin to a place p; coordinate k is the minimum over the set of the second one, shifted in a circle by k:
   pi[(p + k) mod UNIVERSE]. A shingle's values for all k lie side by side in one table, so a set's
   signature is the minimum over rows of that table. Two shingles in one bin can only make signatures more alike.
2. *Bands.* ``BANDS`` bands of ``ROWS`` coordinates: sets with a Jaccard similarity of 0.85 share none of them with a
   chance of 3e-7, of 0.8 with 9e-5 (others share fewer coordinates; similarity 0.5 meets in one of six cases).
3. *Stars.* A bucket's pivot is the set that meets most others over all its buckets, in a cluster its middle.
   Each set is compared exactly with the pivot it meets most often: one comparison a set, however large a
   bucket is. Those that link form a component at once.
4. *The rest.* Only buckets that still hold several components matter. In those of at most ``SMALL`` sets all pairs
   from different components are candidates. The sets of larger ones are joined exactly instead: linked sets share one
   of their first ``n - ceil(n * percent / 100) + 1`` shingles in any common order of all shingles; the
   order here goes from rare to frequent by a count table of fixed size. So a common passage makes no pairs.
5. Candidates are compared on whole sets, unless the distances to their pivots rule a link out (1 - Jaccard is a
   metric), and links are joined to components.

Equal sets are one set throughout (a hash is their name); hashes have 64 bits. A document without words has the
empty set, is linked with nothing and kept. Null texts count as empty. A null ``doc_id`` is a document of its own
set, ignored when the component is named; ``kept`` is true for it only where a component has null ids alone.
Repeated rows are copies with one id: all of them are kept or none. Very long texts are used whole. An empty
table gives no row. Extra columns are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from drawfield.llm.common import give_back, query, stored, table, travels
from drawfield.llm.jaccard import components, distance, linked, named_sets, needed, overlaps, prefix, sql, wanted_sets
from drawfield.llm.shingles import mix, pieces, set_ids, shingle_sets

travels(__name__)

WORDS, PERCENT = 3, 85
BANDS, ROWS = 48, 8
UNIVERSE = 1 << 20
SMALL = 24
COUNTERS = 1 << 20


# --- signatures and bands -----------------------------------------------------------------

class Circulant:
    """Signatures of ``size`` coordinates from two permutations."""

    def __init__(self, size):
        self.size = size
        first, second = (np.argsort(mix(np.arange(UNIVERSE, dtype=np.uint64) + np.uint64(seed)), kind="stable")
                         for seed in (0x51ED270B, 0xA3C59AC3 << 20))
        self.place = first.astype(np.int32)
        self.ring = np.append(second, second[:size]).astype(np.uint32)  # the circle is closed at its end
        self.shifts = np.lib.stride_tricks.sliding_window_view(self.ring, size)

    def signature(self, shingles):
        """The signature of a set of 64-bit hashes."""
        place = self.place[(shingles >> np.uint64(11)) & np.uint64(UNIVERSE - 1)]
        least = np.full(self.size, UNIVERSE, np.uint32)
        for at in range(0, len(place), 2048):
            np.minimum(least, self.shifts[place[at:at + 2048]].min(axis=0), out=least)
        return least


def _circulant(size):
    """One per Python worker: the tables are made once."""
    made = vars(np).setdefault("_kept_circulants", {})
    if size not in made:
        made[size] = Circulant(size)
    return made[size]


def band_keys(signatures, bands, rows):
    """A 64-bit key of each band of each signature."""
    value = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands)).copy()
    for r in range(rows):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r::rows].astype(np.uint64))
    return value.view(np.int64)


def banded(docs, words, bands, rows):
    """``set_id``, ``n``, ``keys`` of the sets of each task, each set once."""
    def run(batches):
        circle, told = _circulant(bands * rows), set()
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part["text"].to_pylist(), words)
                new = {}
                for name, tokens in zip(set_ids(sets).tolist(), sets):
                    if len(tokens) and name not in told:
                        new[name] = tokens
                told.update(new)
                if new:
                    keys = band_keys(np.stack([circle.signature(t) for t in new.values()]), bands, rows)
                    offsets = np.arange(len(new) + 1, dtype=np.int32) * bands
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(new)), pa.array([len(t) for t in new.values()], pa.int32()),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["set_id", "n", "keys"])
        give_back()
    return docs.mapInArrow(run, "set_id long, n int, keys array<long>")


def buckets(docs, words, bands, rows):
    """``key``, ``set_id``, ``n``, ``m``: the sets of every bucket that holds ``m`` > 1 of them."""
    members = stored(banded(docs, words, bands, rows).select(F.explode("keys").alias("key"), "set_id", "n").distinct(), "bands")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    return stored(members.join(stored(shared, "shared"), "key"), "buckets")


# --- the rest, by prefixes ----------------------------------------------------------------

def prefixes(sets, percent):
    """``key``, ``set_id``, ``n``, ``pos``: the leading shingles of ``sets`` (``set_id``, ``n``, ``tokens``), rare ones first.

    Frequencies come from a table of ``COUNTERS`` counters: any order common to all sets is right, and
    this one needs no shuffle of shingles.
    """
    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            tokens = batch["tokens"].flatten().to_numpy().view(np.uint64)
            total += np.bincount((tokens >> np.uint64(17) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    found = (sets.select("tokens").mapInArrow(count, "slot long, n long")
             .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())  # COUNTERS rows at most
    counters = np.zeros(COUNTERS, np.int64)
    counters[found["slot"].to_numpy()] = found["n"].to_numpy()
    held = sets.sparkSession.sparkContext.broadcast(counters)

    def lead(batches):
        often = held.value
        for batch in batches:
            for name, n, tokens in zip(batch["set_id"].to_pylist(), batch["n"].to_pylist(), batch["tokens"]):
                tokens = tokens.values.to_numpy().view(np.uint64)
                slots = (tokens >> np.uint64(17) & np.uint64(COUNTERS - 1)).astype(np.int64)
                first = np.lexsort((tokens, often[slots]))[:prefix(n, percent)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[first].view(np.int64)), pa.array(np.full(len(first), name)),
                     pa.array(np.full(len(first), n, np.int32)), pa.array(np.arange(len(first), dtype=np.int32))],
                    names=["key", "set_id", "n", "pos"])
        give_back()

    return stored(sets.select("set_id", "n", "tokens").mapInArrow(lead, "key long, set_id long, n int, pos int"), "prefixes")


def candidates(lists, placed, percent):
    """``a``, ``b`` with their pivots and distances: pairs of one list's sets from different components whose
    sizes and places in the list allow a link. ``lists``: ``key``, ``set_id``, ``n``, ``pos`` (0 where places say nothing)."""
    rows = stored(lists.join(placed, "set_id"), "placed")
    several = rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    rows = stored(rows.join(several, "key"), "open")
    x, y = (rows.select("key", *[F.col(c).alias(k + c) for c in ("set_id", "n", "pos", "root", "near", "to_near")]) for k in "xy")
    pairs = (x.join(y, "key").filter("xroot <> yroot AND xset_id < yset_id")
             .filter(f"100L * least(xn, yn) >= {percent} * greatest(xn, yn)")
             .filter(f"least(xn - xpos, yn - ypos) >= {needed('xn', 'yn', percent)}"))
    return (pairs.groupBy(F.col("xset_id").alias("a"), F.col("yset_id").alias("b"))
            .agg(*[F.first(c).alias(c) for c in ("xnear", "xto_near", "ynear", "yto_near")]))  # one value a set


def _tested(pairs, sets):
    """``pairs`` (``a``, ``b``) compared on whole sets: ``d``, their distance, and ``ok`` for a link."""
    a = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    return overlaps(pairs.join(a, "a"), sets)


def links(pairs, sets, percent):
    """The links among candidate pairs, told by their pivots where these decide."""
    pairs = stored(pairs.withColumns({"pa": F.least("xnear", "ynear"), "pb": F.greatest("xnear", "ynear")}), "pairs")
    between = stored(_tested(pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), sets)
                     .select(F.col("a").alias("pa"), F.col("b").alias("pb"), distance().alias("dp"), linked(percent).alias("pok")),
                     "between")
    rest = pairs.join(between, ["pa", "pb"]).filter(
        f"NOT pok AND dp - xto_near - yto_near <= {(100 - percent) / 100 + 1e-9}").select("a", "b")
    found = _tested(rest, sets).filter(linked(percent)).select("a", "b")
    return found.unionByName(between.filter("pok").select(F.col("pa").alias("a"), F.col("pb").alias("b")))


# --- the whole join -----------------------------------------------------------------------

def near_duplicates(docs, words=WORDS, percent=PERCENT, bands=BANDS, rows=ROWS):
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = stored(named_sets(docs, words), "named")
    met = buckets(docs, words, bands, rows)
    if not met.limit(1).count():
        return _result(named, None)

    weight = met.groupBy("set_id").agg(F.sum("m").alias("meets"))
    pivots = (met.join(stored(weight, "weights"), "set_id").groupBy("key")
              .agg(F.max(F.struct("meets", "set_id")).alias("p")).select("key", F.col("p.set_id").alias("pivot")))
    votes = (met.join(stored(pivots, "pivots"), "key").filter("pivot <> set_id")
             .groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("votes")))
    best = votes.groupBy("set_id").agg(F.max(F.struct("votes", "pivot")).alias("v")).select("set_id", F.col("v.pivot").alias("pivot"))
    known = wanted_sets(docs, named, met.select("set_id").distinct().join(best, "set_id", "left"), words)
    sets = known.drop("pivot")
    pairs = known.filter("pivot IS NOT NULL").select(
        F.col("set_id").alias("a"), F.col("pivot").alias("b"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    tested = overlaps(pairs, sets).select("a", "b", distance().alias("d"), linked(percent).alias("ok"))
    ties = stored(tested.filter("ok").drop("ok"), "stars")
    star = components(ties.select("a", "b"))
    near = ties.select(F.col("a").alias("set_id"), F.col("b").alias("near"), F.col("d").alias("to_near"))
    if star is None:
        star = ties.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = stored(sets.select("set_id").join(star.withColumnRenamed("node", "set_id"), "set_id", "left")
                    .join(near, "set_id", "left")
                    .select("set_id", F.coalesce("root", "set_id").alias("root"), F.coalesce("near", "set_id").alias("near"),
                            F.coalesce("to_near", F.lit(0.0)).alias("to_near")), "placed")

    small = met.filter(F.col("m") <= SMALL).select("key", "set_id", "n", F.lit(0).alias("pos"))
    found = candidates(small, placed, percent)
    large = met.filter(F.col("m") > SMALL).join(placed.select("set_id", "root"), "set_id")
    several = large.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    rest = stored(large.select("key", "set_id").join(several, "key").select("set_id").distinct(), "rest")
    if rest.limit(1).count():
        found = found.unionByName(candidates(prefixes(sets.join(rest, "set_id"), percent), placed, percent)).dropDuplicates(["a", "b"])
    return _result(named, components(ties.select("a", "b").unionByName(links(found, sets, percent))))


def _result(named, labels):
    """Components bear the smallest ``doc_id`` of their sets."""
    groups = named.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("component"))
    if labels is not None:
        groups = stored(groups.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
                        .withColumn("root", F.coalesce("root", "set_id")), "groups")
        least = groups.groupBy("root").agg(F.min("component").alias("least"))
        groups = groups.join(least, "root").select("set_id", F.col("least").alias("component"))
    # A set without words is no key of a group: such documents stand for themselves.
    return named.join(groups, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op11_circulant_minhash", sql(WORDS, PERCENT, ", doc_id = component_id AS kept"))
def op11_circulant_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
