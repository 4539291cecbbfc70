"""Exact top-k search by BM25: an inverted index a shard, block-max WAND pruning, one exact merge.

* ``build_index`` writes shards of consecutive documents, alike ones side by side: sorted term hashes, and each
  term's postings in document order (local number, frequency), with document lengths. A shard is one row.
* Global statistics make scores comparable: the number of documents, their mean length, and how many
  documents of all shards hold each query term.
* A shard's documents stand in blocks of ``BLOCK`` numbers. For each term that is common in a range of blocks the largest
  contribution in each block is known. A query adds up its rare terms' short posting lists, and the block
  maxima of its common terms. Where both together stay below the query's threshold the block is skipped:
  nothing more is read of it. The other blocks are scored exactly, for all queries of a batch by one matrix product:
  contributions are whole numbers, which single precision adds up exactly below 2**24, double precision beyond.
* The threshold is the k-th best score of every ``FIRST``-th shard: a lower bound of the true k-th score, so no
  answer is lost. What those shards found is kept, so each shard is opened once for a block of queries.
* Each shard gives its k best from the threshold up; the k best of all shards are the answer.

score = sum over the query's distinct terms of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) /
(tf + k1 * (1 - b + b * length / mean length)), each term's share rounded to 1 / SCALE so that sums do
not depend on their order. Ties go to the smaller ``doc_id``. Terms are runs of ASCII letters and
digits and all other characters beyond ASCII, with A-Z in lower case.

Queries come in blocks of about ``QUERY_BYTES`` of text; each block's terms are sent to the executors and
meet the whole index in one pass, so what is broadcast has a bound. Null and empty texts are indexed with
length 0 and never found; such queries give no row. Repeated rows are documents of their own; rows that repeat a
``query_id`` are one query with the terms of all of them. An empty table gives no row. Fewer than k documents with
a common term give fewer rows. Extra columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawfield.llm.common import give_back, query, stored, table, travels
from drawfield.llm.shingles import SIGNS, pieces, word_hashes

travels(__name__)

K1, B, SCALE = 1.2, 0.75, 10_000
BLOCK = 256
RANGE = 8
COMMON = 12
SHARD_POSTINGS = 4_000_000
SHARD_DOCS = 1 << 14
QUERY_BYTES = 32 << 20
PARTS = 64
FIRST = 16
CELLS = 1 << 22
EXACT = (1 << 24) - (1 << 16)
ARRAYS = {"doc_ids": "<i8", "lengths": "<i4", "terms": "<u8", "starts": "<i8", "docs": "<i4", "tfs": "<i4"}


# --- the index -------------------------------------------------------------------------

def bags(texts):
    """For each text ``(distinct terms, how often, length)``."""
    words, counts = word_hashes(texts, SIGNS)
    ends = np.cumsum(counts)
    return [(*np.unique(words[e - c:e], return_counts=True), c) for e, c in zip(ends.tolist(), counts.tolist())]


def build_index(docs):
    """The shards of ``docs`` (``doc_id``, ``text``), stored: all arrays little-endian binary."""
    names = ["first", "n_docs", *ARRAYS]

    def shard(number, ids, held):
        # Alike documents side by side (by their most frequent term, then length): tighter block maxima.
        order = sorted(range(len(held)), key=lambda i: (int(held[i][0][held[i][1].argmax()]) if held[i][2] else 0, held[i][2]))
        ids, held = [ids[i] for i in order], [held[i] for i in order]
        n = [len(b[0]) for b in held]
        term = np.concatenate([b[0] for b in held])
        doc = np.repeat(np.arange(len(held), dtype=np.int32), n)
        tf = np.minimum(np.concatenate([b[1] for b in held]), np.iinfo(np.int32).max).astype(np.int32)
        order = np.argsort(term, kind="stable")
        term = term[order]
        starts = np.flatnonzero(np.diff(term, prepend=~term[:1]))
        terms = term[starts]
        columns = [np.array(ids, np.int64), np.array([b[2] for b in held], np.int32), terms,
                   np.append(starts, len(term)).astype(np.int64), doc[order], tf[order]]
        return pa.RecordBatch.from_arrays(
            [pa.array([number % FIRST == 0]), pa.array([len(held)], pa.int32()),
             *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=names)

    def run(batches):
        number, ids, held, size, step = TaskContext.get().partitionId(), [], [], 0, min(1024, SHARD_DOCS)
        for batch in batches:
            for part in (p.slice(at, step) for p in pieces(batch) for at in range(0, p.num_rows, step)):
                if held and (size >= SHARD_POSTINGS or len(ids) + part.num_rows > SHARD_DOCS):
                    yield shard(number, ids, held)
                    number, ids, held, size = number + 1, [], [], 0
                found = bags(part["text"].to_pylist())
                held += found
                ids += part["doc_id"].to_pylist()
                size += sum(len(f[0]) for f in found)
        if held:
            yield shard(number, ids, held)
        ids, held = [], []
        give_back()

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "first boolean, n_docs int, " + ", ".join(f"{n} binary" for n in ARRAYS)
    return stored(rows.mapInArrow(run, kinds), "bm25-index")


def collection(index):
    """``(documents, mean length)`` over all shards."""
    def run(batches):
        for batch in batches:
            total = [int(np.frombuffer(x.as_buffer(), "<i4").sum()) for x in batch["lengths"]]
            yield pa.RecordBatch.from_arrays([batch["n_docs"].cast(pa.int64()), pa.array(total, pa.int64())], names=["n", "words"])
    row = (index.select("n_docs", "lengths").mapInArrow(run, "n long, words long")
           .agg(F.sum("n"), F.sum("words")).first())
    n, words = row[0] or 0, row[1] or 0
    return n, words / n if n else 0.0


def _present(known, terms):
    """``(places in known, places in terms)`` of the terms that both sorted arrays hold."""
    if not len(known) or not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(terms) < len(known):
        return _present(terms, known)[::-1]
    at = np.minimum(np.searchsorted(terms, known), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == known)
    return hit, at[hit]


def document_frequencies(index, known):
    """In how many documents of all shards each term of a sorted array occurs."""
    size = -(-max(1, len(known)) // PARTS)

    def local(batches):
        total = np.zeros(len(known), np.int32)
        for batch in batches:
            for terms, starts in zip(batch["terms"], batch["starts"]):
                place, at = _present(known, np.frombuffer(terms.as_buffer(), "<u8"))
                starts = np.frombuffer(starts.as_buffer(), "<i8")
                total[place] += (starts[at + 1] - starts[at]).astype(np.int32)
        parts = [total[p * size:(p + 1) * size].astype(np.int64).tobytes() for p in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "df"])

    def added(group):
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in group["df"])
        return pa.table({"part": pa.array(group["part"].to_pylist()[:1], pa.int32()), "df": pa.array([total.tobytes()], pa.binary())})

    rows = (index.select("terms", "starts").mapInArrow(local, "part int, df binary")
            .groupBy("part").applyInArrow(added, "part int, df binary").collect())  # PARTS rows
    found = b"".join(r["df"] for r in sorted(rows, key=lambda r: r["part"]))
    return np.frombuffer(found, "<i8") if found else np.zeros(len(known), np.int64)


# --- searching -------------------------------------------------------------------------

class Shard:
    """A shard opened for a block of queries: contributions of the terms they use, with block maxima.

    Terms in more than one of ``COMMON`` documents of a range (``RANGE`` blocks) are kept there as rows over its
    documents, with their maximum in each block; all other postings stand in one short list a term.
    """

    def __init__(self, row, known, idf, mean):
        array = {c: np.frombuffer(row[c], k) for c, k in ARRAYS.items()}
        self.doc_ids = array["doc_ids"]
        self.blocks = -(-len(self.doc_ids) // BLOCK)
        place, at = _present(known, array["terms"])
        self.local = np.full(len(known) + 1, len(place), np.int32)  # the last local term stands for all others
        self.local[place] = np.arange(len(place))
        first = array["starts"][at]
        count = array["starts"][at + 1] - first
        take = np.repeat(first - np.cumsum(count) + count, count)
        take += np.arange(len(take))
        self.docs = array["docs"][take]
        tf = array["tfs"][take].astype(float)
        del take
        norm = K1 * (1 - B + B * array["lengths"] / mean)
        self.value = np.repeat(idf[place], count)
        self.value *= tf
        self.value *= K1 + 1
        tf += norm[self.docs]
        self.value /= tf
        self.value *= SCALE
        np.rint(self.value, out=self.value)
        self._split(count)
        self.batch = max(16, CELLS // max(self.blocks * BLOCK, len(self.most)))
        self.parts, self.large = np.empty((0, self.blocks, BLOCK), np.float32), {}

    def _split(self, count):
        """Rows of the terms common in a range, lists of all other postings."""
        size, ranges = RANGE * BLOCK, -(-self.blocks // RANGE)
        # A term's documents ascend, so those of one range stand together.
        key = np.repeat(np.arange(len(count)) * ranges, count) + self.docs // size
        edge = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        term, of = np.divmod(key[edge[:-1]], ranges)
        del key
        length = np.diff(edge)
        common = length * COMMON > np.minimum(RANGE, self.blocks - of * RANGE) * BLOCK
        rare = np.repeat(~common, length)
        # A posting is one number of 32 bits: a value above the bits of its document; larger values take several.
        self.bits = max(8, (self.blocks * BLOCK - 1).bit_length())
        limit = (1 << 32 - self.bits) - 1
        value, docs, short = self.value[rare], self.docs[rare], np.bincount(term[~common], length[~common], len(count)).astype(np.int64)
        if value.max(initial=0) > limit:
            times = np.ceil(value / limit).astype(np.int64).clip(1)
            large = np.flatnonzero(times > 1)
            value, docs = (np.repeat(value, times) - _ramp(times) * limit).clip(0, limit), np.repeat(docs, times)
            short += np.bincount(np.searchsorted(np.cumsum(short), large, "right"), times[large] - 1, len(short)).astype(np.int64)
        postings = value.astype(np.uint32)
        postings <<= np.uint32(self.bits)
        postings |= docs.view(np.uint32)
        del value, docs, rare
        raw, end = postings.tobytes(), (np.cumsum(short) * 4).tolist()
        self.lists = np.empty(len(count) + 1, object)
        self.lists[:] = [*(raw[a:b] for a, b in zip([0, *end], end)), b""]
        term, of, begin, end = term[common], of[common], edge[:-1][common], edge[1:][common]
        used = np.unique(term)
        self.row_of = np.full(len(count) + 1, -1, np.int32)
        self.row_of[used] = np.arange(len(used))
        self.most = np.zeros((len(used), self.blocks), np.float32)
        self.ranges = []
        for r in range(ranges):
            held, blocks = np.flatnonzero(of == r), slice(r * RANGE, min((r + 1) * RANGE, self.blocks))
            rows = np.zeros((len(held), (blocks.stop - blocks.start) * BLOCK), np.float32)
            for i, (a, b) in enumerate(zip(begin[held].tolist(), end[held].tolist())):
                rows[i, self.docs[a:b] - r * size] = self.value[a:b]
            places = self.row_of[term[held]]
            self.most[places, blocks] = rows.reshape(len(held), blocks.stop - blocks.start, BLOCK).max(axis=2)
            self.ranges.append((blocks, places, rows))
        # More than rounding in single precision can take from a sum of maxima.
        self.most *= np.float32(1 + 1e-6 * (len(used) + 10))

    def best(self, terms, k, floor=1.0, few=None):
        """``(numbers, scores)`` of the k best documents that reach ``floor``.

        With ``few``, only that many promising blocks are scored: a quick lower bound.
        """
        _, numbers, scores = self.answers(np.asarray(terms), np.array([0, len(terms)]), np.array([floor], float), k, few)
        return numbers, scores

    def answers(self, terms, start, floor, k, few=None):
        """``(query, number, score)`` of the k best documents of each query that reach its floor; query ``q`` has
        the terms ``start[q]`` to ``start[q + 1]``. With ``few``, only that many promising blocks of each are scored."""
        n, floor = len(floor), floor.copy()
        local = self.local[terms]
        asked = np.zeros((n, len(self.most) + 1), np.float32)
        asked[np.repeat(np.arange(n), np.diff(start)), self.row_of[local]] = 1  # terms without a row in the last column
        # No document of a block can gain more from common terms than the sum of the block's maxima.
        top = (asked[:, :-1] @ self.most).astype(float) + 1
        if len(self.parts) < n:  # kept: fresh memory takes longer than what is done with it
            self.parts = np.empty((n, self.blocks, BLOCK), np.float32)
        self.large.clear()
        bits, mask = np.uint32(self.bits), np.uint32((1 << self.bits) - 1)
        for q, (a, b) in enumerate(zip(start[:-1].tolist(), start[1:].tolist())):
            found = np.frombuffer(b"".join(self.lists[local[a:b]].tolist()), np.uint32)
            part = np.bincount((found & mask).view(np.int32), (found >> bits).view(np.int32), self.blocks * BLOCK)
            self.parts[q] = part.reshape(self.blocks, BLOCK)
            gain = self.parts[q].max(axis=1)
            top[q] += gain * (1 + 1e-6)
            if gain.max() > EXACT:
                self.large[q] = part.reshape(self.blocks, BLOCK)
        live, some = top >= floor[:, None], few or max(4, -(-2 * k // BLOCK))
        first = live if few else live & (floor <= 1)[:, None]
        if some < self.blocks and first.any():
            first &= top >= np.partition(np.where(first, top, 0), self.blocks - some, axis=1)[:, [self.blocks - some]]
        found = self._score(asked, first, floor, k)
        if not few and (live & ~first).any():
            if first.any():  # Without a floor, the most promising blocks give one.
                found = self._cut(*found, k)
                reached = np.bincount(found[0], minlength=n) == k
                worst = np.full(n, np.inf)
                np.minimum.at(worst, found[0], found[2])
                floor[reached] = np.maximum(floor, worst)[reached]
            more = self._score(asked, live & ~first & (top >= floor[:, None]), floor, k)
            found = tuple(map(np.concatenate, zip(found, more)))
        return self._cut(*found, k)

    def _score(self, asked, wanted, floor, k):
        """Exact scores of the wanted blocks: ``(query, number, score)`` from the floor up."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for blocks, places, rows in self.ranges:
            some = np.flatnonzero(wanted[:, blocks].any(axis=1))
            if not len(some):
                continue
            terms = asked[np.ix_(some, places)]
            for block in range(blocks.start, blocks.stop):
                docs = slice((block - blocks.start) * BLOCK, (block - blocks.start + 1) * BLOCK)
                on = np.flatnonzero(wanted[some, block])
                if len(on):
                    at, asks = some[on], terms[on] if len(on) < len(some) else terms
                    scores = asks @ rows[:, docs]
                    scores += self.parts[at, block]
                    # Whole numbers below 2**24 add up exactly in single precision.
                    if scores.max() > EXACT:
                        scores = asks.astype(float) @ rows[:, docs].astype(float)
                        scores += [self.large[q][block] if q in self.large else self.parts[q, block] for q in at.tolist()]
                    least = floor[at, None]
                    hit = np.flatnonzero(scores >= least)
                    if len(hit) > 4 * k * len(at) and k < BLOCK:  # the k best of the block
                        hit = np.flatnonzero(scores >= np.maximum(least, np.partition(scores, BLOCK - k, axis=1)[:, [BLOCK - k]]))
                    out.append((at[hit // BLOCK], block * BLOCK + hit % BLOCK, scores.ravel()[hit]))
        return tuple(map(np.concatenate, zip(*out)))

    def _cut(self, query, number, score, k):
        """The k best of each query, equal scores by ``doc_id``."""
        order = np.lexsort((self.doc_ids[number], -score, query))
        query, number, score = query[order], number[order], score[order]
        keep = _ramp(np.unique(query, return_counts=True)[1]) < k
        return query[keep], number[keep], score[keep]


def _ramp(count):
    """0, 1, ... for each count, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _query_terms(queries):
    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                found = [f[0].view(np.int64) for f in bags(part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays([part["query_id"], pa.array(found, pa.list_(pa.int64())), part["size"]],
                                                 names=["query_id", "terms", "size"])
    return queries.mapInArrow(run, "query_id long, terms array<long>, size long")


def search(index, queries, k=10):
    """``query_id``, ``rank`` (from 1), ``doc_id``, ``score`` for each of ``queries`` (``query_id``, ``text``)."""
    n, mean = collection(index)
    queries = (queries.select(F.col("query_id").cast("long").alias("query_id"), "text").filter("query_id IS NOT NULL")
               .withColumn("size", F.octet_length("text").cast("long")))
    queries = stored(_query_terms(queries), "bm25-queries")  # their table is read once, whatever the number of blocks
    blocks, found = max(1, math.ceil((queries.agg(F.sum("size")).first()[0] or 0) / QUERY_BYTES)), None
    repeated = queries.groupBy("query_id").count().filter("count > 1").limit(1).count()
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found_kinds = "query_id long, doc_id long, score double"
    broadcast = index.sparkSession.sparkContext.broadcast
    for block in range(blocks):
        some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        terms = some.select("query_id", "terms")
        if repeated:
            terms = (terms.select("query_id", F.explode("terms").alias("term")).distinct()
                     .groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("terms")))
        rows = terms.toArrow()  # about QUERY_BYTES
        ids, count = rows["query_id"].to_numpy(), rows["terms"].combine_chunks().value_lengths().to_numpy()
        flat = rows["terms"].combine_chunks().flatten().to_numpy().astype(np.int64).view(np.uint64)
        known, place = np.unique(flat, return_inverse=True)
        df = document_frequencies(index, known)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        start, place = np.append(0, np.cumsum(count)), place.astype(np.int32)
        # Alike queries side by side (by their most common term, then length): they read the same lists and blocks.
        common = [max(zip(df[place[a:b]].tolist(), place[a:b].tolist()), default=(0, 0)) for a, b in zip(start.tolist(), start[1:].tolist())]
        order = np.lexsort((count, np.array([c[1] for c in common], np.int64)))
        held = broadcast((known, idf, ids, start, place, order))
        # First the answers of every FIRST-th shard: their k-th score is a lower bound of the query's.
        part = index.filter("first").mapInArrow(_searcher(held, broadcast(np.ones(len(ids))), mean, k), found_kinds)
        part = stored(part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "bm25-first")
        floors = dict(part.filter(F.col("rank") == k).select("query_id", "score").collect())  # a row per query of this block
        floor = np.maximum(1.0, np.rint([floors.get(i, 0) * SCALE for i in ids.tolist()]))
        more = index.filter("NOT first").mapInArrow(_searcher(held, broadcast(floor), mean, k), found_kinds)
        part = part.drop("rank").unionByName(more)
        found = part if found is None else found.unionByName(part)
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))


def _searcher(held, floors, mean, k):
    def run(batches):
        known, idf, ids, start, place, order = held.value
        floor = floors.value
        for batch in batches:
            for n in range(batch.num_rows):
                shard, out = Shard({c: batch[c][n].as_buffer() for c in ARRAYS}, known, idf, mean or 1.0), []
                for at in range(0, len(order), shard.batch):
                    some = order[at:at + shard.batch]
                    terms = [place[start[q]:start[q + 1]] for q in some.tolist()]
                    query, numbers, scores = shard.answers(
                        np.concatenate(terms), np.append(0, np.cumsum([len(t) for t in terms])), floor[some], k)
                    out.append((ids[some[query]], shard.doc_ids[numbers], scores / SCALE))
                columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "score"])
                del shard, out, columns
                give_back()
    return run


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM d),
t AS (SELECT doc_id, len(words) AS length, unnest(words) AS term FROM d),
p AS (SELECT doc_id, term, any_value(length) AS length, count(*) AS tf FROM t GROUP BY doc_id, term),
f AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM p, s GROUP BY term),
w AS (SELECT doc_id, term, CAST(round(idf * tf * {K1 + 1}e0 / (tf + {K1}e0 * ({1 - B}e0 + {B}e0 * length / mean)) * {SCALE}) AS BIGINT) AS share
      FROM p JOIN f USING (term), s),
r AS (SELECT q.doc_id AS query_id, w.doc_id, sum(share) AS total FROM p q JOIN w USING (term) WHERE q.doc_id % 50 = 0 GROUP BY ALL),
b AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY total DESC, doc_id) AS INTEGER) AS rank, doc_id,
             CAST(total AS DOUBLE) / {SCALE}e0 AS score FROM r WHERE total > 0)
SELECT * FROM b WHERE rank <= 10
"""


@query("op1_topk_search", SQL)
def op1_topk_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(build_index(docs), queries, k=10)
