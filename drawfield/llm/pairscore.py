"""Ranked lexical search by MaxScore with bounds on pairs of terms.

1. ``build_index`` writes the documents as shards: a header row (ids, lengths) and a row per term with its
   posting list (local document number, occurrences). Every document and term is indexed.
2. ``build_pairs`` prepares the index for a log of queries: each shard gets the impacts of the log's terms
   by global statistics, and for every pair of a query's ``HEAVY`` longest lists the intersection list with
   its largest joint impact. An intersection of more than a quarter of the shard keeps that maximum alone.
3. ``search``: a query's terms form units, disjoint pairs chosen for what they save, and single terms. A unit's
   bound is the largest joint impact, or a larger impact of one of both terms alone: never more than the sum of
   both maxima. Units are ordered by their bounds; as long as the bounds of the first ones stay below the
   threshold together, no document can be found by them alone, so only the lists of the others are read to
   find candidates. A candidate is then looked up unit by unit: in the pair's intersection (both shares at
   once), and outside of it only if the larger single maximum can still lift it to the threshold.

The threshold is the k-th best of exact scores that a first pass gives for a few good documents of each
shard, hence a lower bound of the true k-th score: no answer is lost, ties included.

score = sum over the query's distinct terms of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) in 64-bit
integers, w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 100 - 50 + ((50 * n * N) div L). Terms are runs of
ASCII letters and digits and all characters beyond ASCII, A-Z in lower case; they are told apart by 64-bit
hashes. N counts documents with a term, L all their terms, n one document's.

Queries are dealt into blocks of about ``BLOCK_TERMS`` terms; a shard and a block meet in one task, whatever the
number of blocks, and nothing but counts passes through the driver. Null, empty and wordless texts are never
found, such queries give no row. Rows that repeat an ``item_id`` (null is one, too) are one query with the terms of all of
them. Repeated documents and null ids are ranked like others; equal scores go by ascending ``doc_id``, null last.
Texts are used whole. Fewer matches than k give fewer rows, empty tables none. Extra columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawfield.llm.common import give_back, query, stored, table, travels
from drawfield.llm.shingles import SIGNS, binaries, pieces, word_hashes

travels(__name__)

TOP = 50
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
HEAVY, LIST_SHARE = 6, 4
BLOCK_TERMS = 100_000


# --- the index of all documents -----------------------------------------------------------

def _bags(texts):
    """``(text number, term, occurrences)`` of all distinct terms of each text, and all terms per text."""
    words, counts = word_hashes(texts, SIGNS)
    ends = np.cumsum(counts)
    found = [np.unique(words[e - c:e], return_counts=True) for e, c in zip(ends.tolist(), counts.tolist())]
    number = np.repeat(np.arange(len(found)), [len(t) for t, _ in found])
    return number, np.concatenate([t for t, _ in found]), np.concatenate([n for _, n in found]), counts


INDEX = "shard long, term long, n long, words long, docs binary, tfs binary, ids array<long>"


def _shard(shard, ids, held):
    """A shard's rows: the header (``term`` null, ``docs`` the lengths), then its terms in order."""
    before = np.cumsum([0, *[len(lengths) for *_, lengths in held]])
    doc = np.concatenate([number + b for (number, *_), b in zip(held, before.tolist())])
    term, tf = (np.concatenate([h[i] for h in held]) for i in (1, 2))
    lengths = np.concatenate([h[3] for h in held])
    order = np.argsort(term.view(np.int64), kind="stable")
    terms, starts = np.unique(term[order].view(np.int64), return_index=True)
    starts = np.append(starts, len(term))
    none = pa.nulls(len(terms), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([shard]), pa.array([None], pa.int64()), pa.array([np.count_nonzero(lengths)], pa.int64()),
         pa.array([lengths.sum()], pa.int64()), pa.array([lengths.astype("<u4").tobytes()]), pa.array([None], pa.binary()),
         pa.array([ids], pa.list_(pa.int64()))], names=["shard", "term", "n", "words", "docs", "tfs", "ids"])
    docs, tfs = doc[order].astype("<u2"), tf[order].astype("<u4")
    for at in range(0, len(terms), 4096):
        run = slice(at, min(at + 4096, len(terms)))
        part = slice(starts[run.start], starts[run.stop])
        edges = starts[run.start:run.stop + 1] - part.start
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(edges) - 1, shard)), pa.array(terms[run]), pa.array(np.diff(edges)),
             pa.nulls(len(edges) - 1, pa.int64()), binaries(docs[part], edges), binaries(tfs[part], edges), none[run]],
            names=["shard", "term", "n", "words", "docs", "tfs", "ids"])


def build_index(docs):
    """The stored index of ``docs`` (``doc_id``, ``text``). A header's ``n`` and ``words`` count the documents
    with a term and all terms; a term's ``n`` counts the documents that hold it."""
    def run(batches):
        shard, ids, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for part in pieces(batch):
                for at in range(0, part.num_rows, 4096):
                    some = part.slice(at, 4096)
                    if len(ids) + some.num_rows > SHARD_DOCS or size >= SHARD_POSTINGS:
                        yield from _shard(shard, ids, held)
                        shard, ids, held, size = shard + 1, [], [], 0
                    held.append(_bags(some["text"].to_pylist()))
                    ids += some["doc_id"].to_pylist()
                    size += len(held[-1][0])
        if ids:
            yield from _shard(shard, ids, held)
        ids, held = [], []
        give_back()

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), "postings")


# --- the log's terms and pairs ------------------------------------------------------------

def _log(items):
    """``q`` (number of a query), ``item_id``, ``block``, ``terms``: stored, one row an item with terms."""
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                number, term, _, _ = _bags(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["item_id"].take(pa.array(number)), pa.array(term.view(np.int64))],
                                                 names=["item_id", "term"])
    terms = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term long").distinct()
    log = stored(terms.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
                 .withColumn("q", F.monotonically_increasing_id()), "log")
    blocks = max(1, math.ceil((log.agg(F.sum(F.size("terms"))).first()[0] or 0) / BLOCK_TERMS))
    return log.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")), blocks


PAIRS = ("shard long, block int, ids array<long>, queries binary, starts binary, terms binary, weights binary, "
         "lists binary, docs binary, ratios binary, pair_a binary, pair_b binary, pair_most binary, pair_starts binary, "
         "pair_docs_a binary, pair_docs_b binary")
_KINDS = {"queries": "<i8", "starts": "<i4", "terms": "<i4", "weights": "<i8", "lists": "<i4", "docs": "<u2", "ratios": "<u4",
          "pair_a": "<i4", "pair_b": "<i4", "pair_most": "<i8", "pair_starts": "<i4", "pair_docs_a": "<u2", "pair_docs_b": "<u2"}


def _prepared(key, group, n_docs, n_words):
    """One shard and block: the queries by local term, lists with impacts, and the intersections of pairs.

    An impact is its term's weight times the list's ratio; an intersection holds places in both lists.
    """
    head = group.filter(pc.is_null(group["term"]))
    group = group.filter(pc.is_valid(group["term"]))
    ids = head["ids"][0].as_py()
    lengths = np.frombuffer(head["docs"][0].as_buffer(), "<u4").astype(np.int64)
    m = 50 + (50 * lengths * n_docs) // max(1, n_words)
    sizes = group["n"].to_numpy()
    lists = np.append(0, np.cumsum(sizes))
    docs = np.frombuffer(b"".join(group["docs"].to_pylist()), "<u2")
    tf = np.frombuffer(b"".join(group["tfs"].to_pylist()), "<u4").astype(np.int64)
    ratio = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
    weights = group["w"].to_numpy()
    impact = ratio * np.repeat(weights, sizes)
    # Queries by local term: the lists name their queries.
    of = group["qs"].combine_chunks()
    q, term = of.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), of.value_lengths().to_numpy())
    order = np.lexsort((-sizes[term], q))
    q, term = q[order], term[order]
    queries, starts = np.unique(q, return_index=True)
    starts = np.append(starts, len(q))
    wanted = set()
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        heavy = sorted(term[a:min(b, a + HEAVY)].tolist())
        wanted.update((x, y) for i, x in enumerate(heavy) for y in heavy[i + 1:])
    wanted = np.array(sorted(wanted), np.int64).reshape(-1, 2)
    most, count, in_a, in_b = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64), [], []
    place, last = np.full(len(ids), -1), -1
    for i, (a, b) in enumerate(wanted.tolist()):
        if a != last:
            place[:] = -1
            place[docs[lists[a]:lists[a + 1]]] = np.arange(sizes[a])
            last = a
        at_a = place[docs[lists[b]:lists[b + 1]]]
        at_b = np.flatnonzero(at_a >= 0)
        at_a = at_a[at_b]
        if len(at_a):
            most[i] = (impact[lists[a] + at_a] + impact[lists[b] + at_b]).max()
        if LIST_SHARE * len(at_a) <= len(ids):
            count[i] = len(at_a)
            in_a.append(at_a)
            in_b.append(at_b)
        else:
            count[i] = -1
    pair_starts = np.append(0, np.cumsum(np.maximum(count, 0)))
    pair_starts[:-1][count < 0] = -1 - pair_starts[:-1][count < 0]  # a negative start: no list
    empty = np.zeros(0, np.int64)
    columns = {"queries": queries, "starts": starts, "terms": term, "weights": weights, "lists": lists, "docs": docs, "ratios": ratio,
               "pair_a": wanted[:, 0], "pair_b": wanted[:, 1], "pair_most": most, "pair_starts": pair_starts,
               "pair_docs_a": np.concatenate([empty, *in_a]), "pair_docs_b": np.concatenate([empty, *in_b])}
    give_back()
    return pa.table({"shard": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()], pa.int32()),
                     "ids": pa.array([ids], pa.list_(pa.int64())),
                     **{c: pa.array([v.astype(_KINDS[c]).tobytes()], pa.binary()) for c, v in columns.items()}})


def build_pairs(index, items):
    """``(log, pairs)``: the queries of ``items`` (``item_id``, ``text``), and a stored row for each shard and block."""
    log, blocks = _log(items)
    n_docs, n_words = index.filter("term IS NULL").agg(F.sum("n"), F.sum("words")).first()
    n_docs, n_words = n_docs or 0, n_words or 0
    wanted = stored(log.select("block", "q", F.explode("terms").alias("term"))
                    .groupBy("block", "term").agg(F.collect_list("q").alias("qs")), "wanted")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.sum("n") + 1)))
    weights = stored(index.select("term", "n").join(wanted.select("term").distinct(), "term")
                     .groupBy("term").agg(weight.cast("long").alias("w")), "weights")
    wanted = stored(wanted.join(weights, "term"), "wanted")
    lists = index.select("shard", "term", "n", "docs", "tfs").join(wanted, "term").select(
        "shard", "block", "term", "n", "docs", "tfs", F.lit(None).cast("array<long>").alias("ids"), "w", "qs")
    heads = index.filter("term IS NULL").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "term", "n", "docs", "tfs", "ids",
        F.lit(0).cast("long").alias("w"), F.lit(None).cast("array<long>").alias("qs"))

    def prepare(key, group):
        return _prepared(key, group, n_docs, n_words)

    return log, stored(lists.unionByName(heads).groupBy("shard", "block").applyInArrow(prepare, PAIRS), "pairs")


# --- searching ----------------------------------------------------------------------------

class Shard:
    """A prepared shard, opened for the queries of one block."""

    def __init__(self, row):
        array = {c: np.frombuffer(row[c], k) for c, k in _KINDS.items()}
        self.ids, self.n_docs = row["ids"], len(row["ids"])
        self.queries, self.starts, self.terms = array["queries"], array["starts"].tolist(), array["terms"]
        self.lists, self.docs = array["lists"].tolist(), array["docs"]
        sizes = np.diff(array["lists"])
        self.impact = array["ratios"].astype(np.int64) * np.repeat(array["weights"], sizes)
        # A list is never empty, so each has a largest impact.
        self.most = np.maximum.reduceat(self.impact, array["lists"][:-1]).tolist() if len(sizes) else []
        self.pair = {p: i for i, p in enumerate(zip(array["pair_a"].tolist(), array["pair_b"].tolist()))}
        self.joint, self.pair_starts = array["pair_most"].tolist(), array["pair_starts"].tolist()
        self.in_a, self.in_b = array["pair_docs_a"], array["pair_docs_b"]

    def units(self, terms):
        """``(bound, terms, pair)`` by ascending bound: disjoint pairs, those that save most first, and the rest."""
        saving = []
        heavy = sorted(terms[:HEAVY])
        for i, a in enumerate(heavy):
            for b in heavy[i + 1:]:
                bound = max(self.joint[self.pair[a, b]], self.most[a], self.most[b])
                saving.append((self.most[a] + self.most[b] - bound, a, b, bound))
        left, units = set(terms), []
        for gain, a, b, bound in sorted(saving, reverse=True):
            if gain > 0 and a in left and b in left:
                left -= {a, b}
                units.append((bound, (a, b), self.pair[a, b]))
        units += [(self.most[t], (t,), None) for t in left]
        return sorted(units, key=lambda u: u[:2])

    def _shares(self, docs, listed, impacts):
        """The impacts of sorted ``docs`` in a list; 0 where it does not hold them."""
        at = np.minimum(np.searchsorted(listed, docs), len(listed) - 1)
        return np.where(listed[at] == docs, impacts[at], 0)

    def add(self, unit, docs, score, enough):
        """The candidates with the unit's shares added; those go that cannot reach ``enough`` any more."""
        bound, terms, pair = unit
        keep = score + bound >= enough
        docs, score = docs[keep], score[keep]
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in terms]
        start = self.pair_starts[pair] if pair is not None else -1
        if start < 0:
            for s in spans:
                score = score + self._shares(docs, self.docs[s], self.impact[s])
        else:
            after = self.pair_starts[pair + 1]
            part = slice(start, after if after >= 0 else -1 - after)
            a, b = spans
            both = self.docs[b][self.in_b[part]]
            joint = self.impact[a][self.in_a[part]] + self.impact[b][self.in_b[part]]
            share = self._shares(docs, both, joint) if len(both) else np.zeros(len(docs), np.int64)
            # Outside of the intersection a document holds one of both terms at most.
            alone = max(self.most[t] for t in terms)
            inside = np.isin(docs, both, assume_unique=True) if len(both) else np.zeros(len(docs), bool)
            keep = inside | (score + alone >= enough)
            docs, share, score, inside = docs[keep], share[keep], score[keep], inside[keep]
            out = np.flatnonzero(~inside)
            for s in spans:
                share[out] += self._shares(docs[out], self.docs[s], self.impact[s])
            score = score + share
        keep = score >= enough
        return docs[keep], score[keep]

    def gathered(self, terms):
        """Each document's sum over the whole lists of some terms."""
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in terms]
        docs = np.concatenate([self.docs[s] for s in spans])
        # Sums stay far below 2**53, so doubles hold them exactly.
        return np.bincount(docs, np.concatenate([self.impact[s] for s in spans]), self.n_docs).astype(np.int64)

    def terms_of(self, number):
        return self.terms[self.starts[number]:self.starts[number + 1]].tolist()

    def quick(self, number, k):
        """Exact scores of a few documents that look good by the terms of the largest impacts."""
        units = self.units(self.terms_of(number))
        first = self.gathered([t for u in units[-3:] for t in u[1]])
        few = min(4 * k, self.n_docs)
        docs = np.sort(np.argpartition(-first, few - 1)[:few])
        docs = docs[first[docs] > 0]
        score = first[docs]
        for unit in units[:-3]:
            docs, score = self.add(unit, docs, score, 1)
        return np.sort(score)[::-1][:k]

    def best(self, number, k, floor):
        """``(documents, scores)`` of the k best that reach ``floor`` (1 at least)."""
        units = self.units(self.terms_of(number))
        slack = np.cumsum([u[0] for u in units])
        optional = int(np.searchsorted(slack, floor, side="left"))
        if optional == len(units):  # all bounds together stay below the threshold: the shard has no answer
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        part = self.gathered([t for u in units[optional:] for t in u[1]])
        more = int(slack[optional - 1]) if optional else 0
        docs = np.flatnonzero((part > 0) & (part + more >= floor))
        score = part[docs]
        for at in reversed(range(optional)):
            rest = int(slack[at - 1]) if at else 0
            docs, score = self.add(units[at], docs, score, floor - rest)
        if len(docs) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            docs, score = docs[score >= least], score[score >= least]
        return docs, score


def _kth(k):
    return F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"))) == k


def search(log, pairs, shards, k=TOP):
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the k best documents of each query."""
    each = max(2, -(-2 * k // max(1, shards)))

    def opened(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                yield Shard(row), row.get("floors") or []
                give_back()

    def quick(batches):
        for shard, _ in opened(batches):
            found = [shard.quick(i, each) for i in range(len(shard.queries))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shard.queries, [len(s) for s in found])), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))],
                names=["q", "score"])

    def whole(batches):
        for shard, floors in opened(batches):
            floor = {f["q"]: f["score"] for f in floors}
            out = [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for i, q in enumerate(shard.queries.tolist()):
                docs, score = shard.best(i, k, max(1, floor.get(q, 1)))
                out[0].append(np.full(len(docs), q))
                out[1].extend([shard.ids[d] for d in docs.tolist()])
                out[2].append(score)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out[0])), pa.array(out[1], pa.int64()), pa.array(np.concatenate(out[2]))],
                names=["q", "doc_id", "score"])

    first = pairs.mapInArrow(quick, "q long, score long")
    floors = (first.withColumn("kth", _kth(k)).filter("kth").join(log.select("q", "block"), "q")
              .groupBy("block").agg(F.collect_list(F.struct("q", "score")).alias("floors")))
    # A block's floors are as many as its queries; stored, Spark knows their size and joins accordingly.
    found = pairs.join(stored(floors, "floors"), "block", "left").mapInArrow(whole, "q long, doc_id long, score long")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(log.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_words FROM d WHERE len(words) > 0),
t AS (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d),
p AS (SELECT doc_id, term, any_value(n) AS n, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
b AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM b WHERE rank <= 50
"""


@query("op13_pair_maxscore", SQL)
def op13_pair_maxscore(spark, sf_dir):
    index = build_index(table(spark, sf_dir, "documents"))
    log, pairs = build_pairs(index, table(spark, sf_dir, "benchmark"))
    return search(log, pairs, index.filter("term IS NULL").count())
