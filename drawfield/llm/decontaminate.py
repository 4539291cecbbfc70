"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

1. Word frequencies are counted over all documents, for the words of the benchmark.
2. An item's seeds are its n-grams that chance would hardly produce (the product of its words' frequencies
   is at most ``RARE``, or promises at most one in all documents), and always its ``ALWAYS`` rarest. Rarity by words, not by occurrences of the n-gram:
   a leaked passage stays rare however often it leaked.
3. Where a document has a seed, the words around it are aligned with the item by Smith-Waterman
   (match 2, mismatch and gap -1). The score is divided by that of the whole item matched word by word,
   so an edited copy scores by how much of the item it still holds, in order.

The benchmark is used in blocks of about ``BLOCK_BYTES`` of text; each is sent to the executors and meets
all documents in one pass, so what is broadcast does not grow with the benchmark. Documents are handled
row by row and are never shuffled.

Null and empty texts hold nothing, and items without words match nothing. Repeated documents are
reported alike, repeated items (same id and text) once. An empty table gives no row. Extra columns are
not read. Long texts are searched whole; the alignment is done around seeds only.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from drawfield.llm.common import give_back, query, table, text_bytes, travels
from drawfield.llm.shingles import SIGNS, mix, pieces, word_hashes

travels(__name__)

N, RARE, ALWAYS = 2, 1e-7, 4
SCORE = 0.5
BLOCK_BYTES = 8 << 20
MATCH, MISS, GAP = 2, 1, 1
MAP_BITS = 22


def _lowered(texts):
    return [(t or "").lower() for t in texts]


class Members:
    """Which of many hashes are in a sorted array: a bit map first, then a search."""

    def __init__(self, values):
        self.values = values
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[self._place(values)] = True

    @staticmethod
    def _place(x):
        return (x >> np.uint64(64 - MAP_BITS)).astype(np.int64)

    def find(self, x):
        """``(positions in x, positions in the array)`` of the members."""
        at = np.flatnonzero(self.map[self._place(x)])
        if not len(self.values):
            return at[:0], at[:0]
        place = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        hit = self.values[place] == x[at]
        return at[hit], place[hit]


def grams(words, n):
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = mix(out + words[k:k + len(out)] * np.uint64(2 * k + 3))
    return out


def count_words(docs, known):
    """Occurrences of the ``known`` words, and of all words, in all documents."""
    def run(batches):
        give_back()
        members, total, found = Members(known), 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for part in pieces(batch):
                words, _ = word_hashes(_lowered(part["text"].to_pylist()), SIGNS)
                total += len(words)
                found += np.bincount(members.find(words)[1], minlength=len(known))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(found[seen], total))],
                                         names=["word", "n"])
    rows = (docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .collect())  # a row per word of this block of the benchmark
    counts, total = np.zeros(len(known)), 0
    for word, n in rows:
        if word < 0:
            total = n
        else:
            counts[word] = n
    return counts, max(1, total)


class Items:
    """A block of the benchmark: words of each item, and seeds with the place they have in it."""

    def __init__(self, ids, texts):
        words, counts = word_hashes(_lowered(texts), SIGNS)
        self.ids, self.words = ids, np.split(words, np.cumsum(counts)[:-1]) if len(ids) else []
        self.known = np.unique(words)

    def choose_seeds(self, counts, total):
        share = np.log(np.maximum(counts, 1) / total)
        rows = []
        for item, words in enumerate(self.words):
            if not len(words):
                continue
            n = min(N, len(words))
            rare = share[np.searchsorted(self.known, words)]
            chance = sum(rare[k:k + len(words) - n + 1] for k in range(n))
            keep = chance <= math.log(max(RARE, 1 / total))
            keep[np.argsort(chance, kind="stable")[:ALWAYS]] = True
            at = np.flatnonzero(keep)
            rows.append((np.full(len(at), n), grams(words, n)[at], np.full(len(at), item), at))
        n, seed, item, at = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, int),) * 4
        self.seeds = {}
        for k in np.unique(n).tolist():
            mine = n == k
            order = np.argsort(seed[mine], kind="stable")
            values, first, count = np.unique(seed[mine][order], return_index=True, return_counts=True)
            self.seeds[k] = (Members(values), first, count, item[mine][order], at[mine][order])

    def hits(self, words, text_of_word):
        """``(word position, item, position in item)`` of all seeds found within one text."""
        found = []
        for n, (members, first, count, item, at) in self.seeds.items():
            where, seed = members.find(grams(words, n))
            inside = text_of_word[where] == text_of_word[where + n - 1] if len(where) else np.zeros(0, bool)
            where, seed = where[inside], seed[inside]
            many = count[seed]
            entry = np.repeat(first[seed], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((np.repeat(where, many), item[entry], at[entry]))
        return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def align(item, text):
    """``(score, first, last)`` of the best local alignment of two word arrays; last is exclusive."""
    score, last = _best(item, text)
    if score <= 0:
        return 0, 0, 0
    _, length = _best(item[::-1], text[:last][::-1], score)
    return score, last - length, last


def _best(item, text, wanted=None):
    n = len(text)
    slope = GAP * np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(text == word, MATCH, -MISS), row[1:] - GAP)
        fresh = np.concatenate([[0], np.maximum(step, 0)])
        row = np.maximum.accumulate(fresh + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        if wanted is not None and best >= wanted:
            break
    return best, end


def spans(hits, lengths):
    """Stretches of a document to align with an item: around its seeds, overlapping ones merged."""
    where, at, length = hits[0], hits[1], lengths
    slack = length // 4 + 2
    low, high = where - at - slack, where - at + length + slack
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    start = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return zip(low[start].tolist(), high[np.append(start[1:] - 1, len(high) - 1)].tolist())


def leaks(docs, benchmark, least=SCORE):
    """``doc_id``, ``item_id``, ``score`` (0 to 1), ``first_word``, ``last_word`` of each leaked item.

    docs: ``doc_id``, ``text``; benchmark: ``item_id``, ``text``. The best alignment of a pair counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    _, size = text_bytes(tests)
    blocks, result = max(1, math.ceil(size / BLOCK_BYTES)), None
    for block in range(blocks):
        rows = (tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
                .orderBy("item_id", "text").toArrow())  # about BLOCK_BYTES
        items = Items(rows["item_id"].to_pylist(), rows["text"].to_pylist())
        items.choose_seeds(*count_words(docs, items.known))
        found = docs.mapInArrow(_search(items, least),
                                "doc_id long, item_id long, score double, first_word long, last_word long")
        result = found if result is None else result.unionByName(found)
    return result


def _search(items, least):
    def run(batches):
        give_back()
        for batch in batches:
            out = []
            for part in pieces(batch):
                ids = part["doc_id"].to_pylist()
                words, counts = word_hashes(_lowered(part["text"].to_pylist()), SIGNS)
                text_of_word = np.repeat(np.arange(len(ids)), counts)
                first = np.cumsum(counts) - counts
                where, item, at = items.hits(words, text_of_word)
                doc = text_of_word[where]
                order = np.lexsort((where, item, doc))
                where, item, at, doc = where[order], item[order], at[order], doc[order]
                edges = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(item, prepend=-1)) if len(doc) else []
                for s, e in zip(edges, np.append(edges[1:], len(doc)) if len(doc) else []):
                    d, wanted = int(doc[s]), items.words[item[s]]
                    text = words[first[d]:first[d] + counts[d]]
                    best = (0, 0, 0)
                    for low, high in spans((where[s:e] - first[d], at[s:e]), len(wanted)):
                        low = max(low, 0)
                        score, begin, end = align(wanted, text[low:high])
                        best = max(best, (score, -low - begin, low + end))
                    if best[0] >= least * MATCH * len(wanted):
                        out.append((ids[d], items.ids[item[s]], best[0] / (MATCH * len(wanted)), -best[1], best[2]))
            kinds = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                     ("first_word", pa.int64()), ("last_word", pa.int64())]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)],
                                             names=[n for n, _ in kinds])
    return run


@query("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
