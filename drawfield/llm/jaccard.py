"""N-gram Jaccard join with skipping by set relations: which texts have almost the same word shingles.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of distinct word shingles.
The result is the links' components. Every link between different sets is found or implied:

1. Equal sets become one (their hash is their name).
2. Shingles are ordered from rare to frequent by exact counts over all documents. In that order,
   linked sets share one of their first ``n - ceil(n * percent / 100) + 1`` shingles, so only those
   are indexed. Counting moves each shingle once, packed by hash range; shingles of one document stay.
3. An index list's first set (fewest rarer shingles) is its pivot. Each set is compared with the pivot
   that it meets in most lists; those that link form a star whose answers are known together.
4. Lists are cut into blocks by position and size. A pair of blocks is skipped when position and size
   rule out the overlap that a link needs, or when both lie in one star; only sets of surviving
   blocks and of different stars are paired. With d = 1 - Jaccard, a metric, the distance of two
   pivots decides for their stars: linked pivots join them whole, and a member pair is skipped when
   d(pivots) less both distances to the pivots exceeds what a link allows. The rest is compared.

A document without words has an empty set, links with nothing and is its own component. Null texts
count as empty. Repeated rows are copies, and a null ``doc_id`` is taken as a document of its own set,
its id ignored for naming the component unless all are null. An empty table gives no row. Extra columns
are not read; texts are used whole, however long.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from drawfield.llm.common import bit_map, give_back, query, stored, table, text_bytes, travels
from drawfield.llm.shingles import pieces, set_ids, shingle_sets

travels(__name__)

WORDS, PERCENT = 4, 85
BUCKET_BYTES = 8 << 20
BLOCK = 8


def prefix(n, percent):
    """How many shingles of a set of ``n`` are indexed."""
    return n - (n * percent + 99) // 100 + 1


def _sets(batches, words):
    """``(doc_ids, set ids, sets)`` of bounded runs of rows."""
    for batch in batches:
        for part in pieces(batch):
            sets = shingle_sets(part["text"].to_pylist(), words)
            yield part["doc_id"], set_ids(sets), sets


def named_sets(docs, words=WORDS):
    """``doc_id``, ``set_id``, ``n``: each document's set, by name and size."""
    def run(batches):
        give_back()
        for ids, names, sets in _sets(batches, words):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(names), pa.array([len(s) for s in sets], pa.int32())],
                names=["doc_id", "set_id", "n"])
        give_back()
    return docs.mapInArrow(run, "doc_id long, set_id long, n int")


def _packed(bucket, name, each, once):
    """Rows of one bucket each, from columns sorted by bucket. ``once``: columns told once for each run
    of one set's shingles, with the length of the run."""
    new = (bucket[1:] != bucket[:-1]) | (name[1:] != name[:-1])
    run = np.flatnonzero(np.concatenate([[True], new])) if len(bucket) else np.zeros(0, np.int64)
    once = {"name": name[run], **{c: v[run] for c, v in once.items()}, "run": np.diff(np.append(run, len(name))).astype(np.int32)}
    arrays, names = [], []
    for columns, key in ((each, bucket), (once, bucket[run])):
        edges = np.flatnonzero(np.diff(key, prepend=-1))
        last = np.append(edges[1:], len(key)).tolist()
        for c, v in columns.items():
            names.append(c)
            arrays.append(pa.array([v[a:b].tobytes() for a, b in zip(edges.tolist(), last)], pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(key[edges].astype(np.int32)), *arrays], names=["bucket", *names])


def _runs(group, *columns):
    """Columns told once a run, repeated for each shingle."""
    run = _unpacked(group, "run", np.int32)
    return [np.repeat(_unpacked(group, c, k), run) for c, k in columns]


def _unpacked(group, column, kind):
    return np.frombuffer(b"".join(group[column].to_pylist()), kind)


def index(docs, words, percent, buckets):
    """Index rows: ``token``, ``set_id``, ``n``, ``pos`` (place in the set's order), of shared shingles."""
    def by_token(batches):
        seen, held, size = set(), [], 0

        def flush():
            name = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            n = np.repeat(np.array([len(h[1]) for h in held], np.int32), [len(h[1]) for h in held])
            token = np.concatenate([h[1] for h in held])
            bucket = (token >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            return _packed(bucket[order].astype(np.int64), name[order], {"token": token[order]}, {"n": n[order]})

        for _, names, sets in _sets(batches, words):
            for name, tokens in zip(names.tolist(), sets):
                if len(tokens) and name not in seen:
                    seen.add(name)
                    held.append((name, tokens))
                    size += len(tokens)
            if size > 500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        give_back()

    def shared(group):
        give_back()
        token = _unpacked(group, "token", np.uint64)
        name, n = _runs(group, ("name", np.int64), ("n", np.int32))
        order = np.lexsort((name, token))
        token, name, n = token[order], name[order], n[order]
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name, n = token[first], name[first], n[first]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        df = np.diff(np.append(edges, len(token)))
        df = np.repeat(df, df)
        keep = df > 1
        token, name, n, df = token[keep], name[keep], n[keep], df[keep].astype(np.int32)
        bucket = ((name.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((name, bucket))
        packed = _packed(bucket[order], name[order], {"token": token[order], "df": df[order]}, {"n": n[order]})
        return pa.Table.from_batches([packed])

    def leading(group):
        give_back()
        token, df = _unpacked(group, "token", np.uint64), _unpacked(group, "df", np.int32)
        name, n = _runs(group, ("name", np.int64), ("n", np.int32))
        order = np.lexsort((token, df, name))
        token, name, n = token[order], name[order], n[order].astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, int)
        count = np.diff(np.append(edges, len(name)))
        # Shingles of this set alone come first: they only move the others back.
        pos = n - np.repeat(count, count) + np.arange(len(name)) - np.repeat(edges, count)
        keep = pos < prefix(n, percent)
        return pa.table({"token": token[keep].view(np.int64), "set_id": name[keep],
                         "n": n[keep].astype(np.int32), "pos": pos[keep].astype(np.int32)})

    runs = "name binary, n binary, run binary"
    return (docs.mapInArrow(by_token, f"bucket int, token binary, {runs}")
            .groupBy("bucket").applyInArrow(shared, f"bucket int, token binary, df binary, {runs}")
            .groupBy("bucket").applyInArrow(leading, "token long, set_id long, n int, pos int"))


def wanted_sets(docs, named, wanted, words):
    """``set_id``, ``tokens``, ``n`` of the sets in ``wanted`` (``set_id`` and more), each from its first document.

    A bit map of fixed size (2**26 bits) of the wanted documents' ids keeps other texts from being
    hashed; the join after it is exact. A null id counts as an id: it stands for sets that no other
    document holds, and each task tells such a set once.
    """
    firsts = named.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    ids = stored(wanted.join(firsts, "set_id"), "wanted")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 26))
    rows = bit_map(ids, "doc_id").toArrow()  # 2**20 rows at most
    bits = np.zeros(1 << 20, np.int64)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bit_map = held.value.view(np.uint64)
        told = set()
        for batch in batches:
            place = batch["place"].to_numpy()
            hit = (bit_map[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            if batch.num_rows:
                for doc_ids, names, sets in _sets([batch], words):
                    new = np.ones(len(names), bool)
                    for i in np.flatnonzero(doc_ids.is_null().to_numpy(zero_copy_only=False)).tolist():
                        new[i] = names[i] not in told
                        told.add(names[i])
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, pa.array(names), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                        names=["doc_id", "set_id", "tokens"]).filter(pa.array(new))
        give_back()

    found = (docs.withColumn("place", place)
             .mapInArrow(run, "doc_id long, set_id long, tokens array<long>"))
    more = [c for c in wanted.columns if c != "set_id"]
    ids = ids.withColumnsRenamed({"doc_id": "id", "set_id": "name"})
    same = (F.col("set_id") == F.col("name")) & F.col("doc_id").eqNullSafe(F.col("id"))
    return stored(found.join(ids, same).dropDuplicates(["doc_id", "set_id"])
                  .select("set_id", "tokens", F.size("tokens").alias("n"), *more), "sets")


def compared(pairs, sets):
    """``pairs`` (``a``, ``b`` and more) with ``both``, the size of the overlap, ``na`` and ``nb``."""
    a = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    return overlaps(pairs.join(a, "a"), sets)


def overlaps(pairs, sets):
    """The same for ``pairs`` that bring the first set, ``ta`` and ``na``."""
    b = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    return (pairs.join(b, "b").withColumn("both", F.size(F.array_intersect("ta", "tb")))
            .drop("ta", "tb"))


def linked(percent):
    return F.expr(f"100L * both >= {percent} * (na + nb - both)")


def distance():
    return F.expr("1 - both / cast(na + nb - both as double)")


def roots(edges):
    """``node``, ``root`` of every node that has an edge, from edges ``node`` -> ``up`` without cycles."""
    at = stored(edges, "roots")
    while True:
        above = at.select(F.col("node").alias("up"), F.col("up").alias("further"))
        step = stored(at.join(above, "up", "left").select("node", F.coalesce("further", "up").alias("up"),
                                                          F.col("further").isNotNull().alias("moved")), "roots")
        at = step.select("node", "up")
        if not step.filter("moved").limit(1).count():
            return at.withColumnRenamed("up", "root")


def components(edges):
    """``node``, ``root`` (the component's smallest node) of every node on an edge ``a``, ``b``.

    Each round every component hooks onto the smallest neighbour that is smaller than itself, then all
    chains are cut short; at least every local maximum disappears, in practice far more.
    """
    labels = None
    now = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                 .distinct(), "edges")
    while now.limit(1).count():
        up = roots(now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up")))
        if labels is None:
            labels = up
        else:
            more = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            fresh = up.join(labels.select("node"), "node", "left_anti")
            labels = stored(labels.join(more, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
                            .unionByName(fresh.select("node", "root")), "labels")
        a, b = (up.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab")
        ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
        now = stored(now.join(a, "a", "left").join(b, "b", "left").select(ra.alias("x"), rb.alias("y"))
                     .filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                     .distinct(), "edges")
    return labels


def needed(na, nb, percent):
    """The overlap that a link of two sizes needs, as SQL."""
    return f"ceil({percent} * ({na} + {nb}) / (100D + {percent}))"


def join(docs, words=WORDS, percent=PERCENT):
    """``doc_id``, ``n_shingles``, ``component_id`` for every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, size = text_bytes(docs)
    buckets = max(16, math.ceil(size / BUCKET_BYTES))
    named = stored(named_sets(docs, words), "named")
    rows = stored(index(docs, words, percent, buckets), "index")
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("pos", "set_id")).alias("p"))
    met = stored(rows.join(lists.filter("m > 1").select("token", F.col("p.set_id").alias("pivot")), "token"), "met")
    if not met.limit(1).count():  # no list of two sets, so no link
        return _named_components(named, None)

    # Stars: the pivot met most often. Positions fall along a chain of pivots only by chance, so a
    # set hooks onto a smaller name only, and the larger of two that chose each other onto the other.
    votes = met.filter("pivot <> set_id").groupBy("set_id", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("set_id").agg(F.max(F.struct("votes", "pivot")).alias("v")).select(
        "set_id", F.col("v.pivot").alias("pivot"))
    wanted = met.select("set_id").distinct().join(best, "set_id", "left")
    known = wanted_sets(docs, named, wanted, words)
    sets = known.drop("pivot")
    # A set is stored with the name of its pivot: only it travels to the pivot's set.
    pairs = known.filter("pivot IS NOT NULL").select(
        F.col("set_id").alias("a"), F.col("pivot").alias("b"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    tested = stored(overlaps(pairs, sets).select("a", "b", distance().alias("d"), linked(percent).alias("ok")), "tested")
    ties = tested.filter("ok").select("a", "b")
    star = components(ties)
    if star is None:  # no star: every set stands for itself, and step 4 compares them
        star = ties.select(F.col("a").alias("node"), F.col("b").alias("root"))
    near = tested.filter("ok").select(F.col("a").alias("set_id"), F.col("b").alias("near"), F.col("d").alias("to_near"))
    placed = stored(met.join(star.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
                    .join(near, "set_id", "left")
                    .select("token", "set_id", "n", "pos", F.coalesce("root", "set_id").alias("star"),
                            F.coalesce("near", "set_id").alias("near"), F.coalesce("to_near", F.lit(0.0)).alias("to_near")),
                    "placed")

    open_lists = placed.groupBy("token").agg(F.min("star").alias("x"), F.max("star").alias("y")).filter("x < y").select("token")
    left = placed.join(open_lists, "token").withColumn("block", (F.col("pos") / BLOCK).cast("int") * 64
                                                       + F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int"))
    left = stored(left, "open")
    blocks = left.groupBy("token", "block").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"),
        F.max(F.col("n") - F.col("pos")).alias("tail"), F.min("star").alias("s"), F.max("star").alias("t"))
    x, y = (blocks.select("token", *[F.col(c).alias(k + c) for c in ("block", "low", "high", "pos", "tail", "s", "t")])
            for k in "xy")
    alive = (x.join(y, "token").filter("xblock <= yblock")
             .filter(f"least(xtail, ytail) >= {needed('xlow', 'ylow', percent)}")
             .filter(f"100L * xhigh >= {percent} * ylow AND 100L * yhigh >= {percent} * xlow")
             .filter("NOT (xs = xt AND ys = yt AND xs = ys)").select("token", "xblock", "yblock"))
    cols = ("set_id", "n", "pos", "star", "near", "to_near")
    p, q = (left.select("token", F.col("block").alias(k + "block"), *[F.col(c).alias(k + c) for c in cols]) for k in "xy")
    pairs = (alive.join(p, ["token", "xblock"]).join(q, ["token", "yblock"])
             .filter("xstar <> ystar AND (xblock < yblock OR xset_id < yset_id)")
             .filter(f"least(xn - xpos, yn - ypos) >= {needed('xn', 'yn', percent)}")
             .filter(f"100L * least(xn, yn) >= {percent} * greatest(xn, yn)")
             .groupBy(F.least("xset_id", "yset_id").alias("a"), F.greatest("xset_id", "yset_id").alias("b"))
             .agg(F.min(F.when(F.col("xset_id") < F.col("yset_id"), F.struct("xnear", "xto_near", "ynear", "yto_near"))
                        .otherwise(F.struct(F.col("ynear").alias("xnear"), F.col("yto_near").alias("xto_near"),
                                            F.col("xnear").alias("ynear"), F.col("xto_near").alias("yto_near")))).alias("r")))
    pairs = stored(pairs.select("a", "b", "r.*"), "pairs")
    # What the pivots' comparison says about their members.
    between = compared(pairs.select(F.least("xnear", "ynear").alias("a"), F.greatest("xnear", "ynear").alias("b")).distinct(),
                       sets).select(F.col("a").alias("pa"), F.col("b").alias("pb"), distance().alias("dp"),
                                    linked(percent).alias("pok"))
    between = stored(between, "between")
    rest = pairs.withColumns({"pa": F.least("xnear", "ynear"), "pb": F.greatest("xnear", "ynear")}).join(between, ["pa", "pb"])
    rest = rest.filter(f"NOT pok AND dp - xto_near - yto_near <= {(100 - percent) / 100 + 1e-9}").select("a", "b")
    links = compared(rest, sets).filter(linked(percent)).select("a", "b")
    edges = (ties.unionByName(between.filter("pok").select(F.col("pa").alias("a"), F.col("pb").alias("b")))
             .unionByName(links))
    return _named_components(named, components(edges))


def _named_components(named, labels):
    """Components get the name of their smallest document."""
    groups = named.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    if labels is None:
        groups = groups.withColumnRenamed("first", "component")
    else:
        groups = stored(groups.join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
                        .select("set_id", "first", F.coalesce("root", "set_id").alias("root")), "groups")
        groups = (groups.join(groups.groupBy("root").agg(F.min("first").alias("component")), "root")
                  .select("set_id", "component"))
    return named.join(groups, "set_id", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def sql(words, percent, more=""):
    """The same components in SQL by comparing all pairs of documents that share a shingle."""
    span = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= {words} THEN [{span} FOR i IN range(1, len(w) - {words} + 2)]
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingles FROM t),
    g AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
    e AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
          GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
    r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b),
    f AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id{more} FROM s JOIN f USING (doc_id)
    """


@query("op9_jaccard_join", sql(WORDS, PERCENT))
def op9_jaccard_join(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))
