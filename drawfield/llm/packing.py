"""Packing: order-preserving dynamic programming over window cuts.

Documents keep their order (``doc_id``). Their ids form one stream per range of ``doc_id``; the stream
is cut into windows of at most ``window`` ids. A cut costs the padding it leaves in the window, plus a
penalty: none at the end of a document, ``SENTENCE`` at the end of a sentence inside one, ``INSIDE``
elsewhere (offered every ``STRIDE`` ids where no better cut is near). All ends of documents and sentences are
offered. The cheapest cuts are

    cost[j] = penalty[j] + window - p[j] + min(cost[i] + p[i]  for p[j] - window <= p[i] < p[j])

and the minimum over that sliding range comes from a monotone queue, so a stretch takes linear time.

Null and empty texts are documents of the end id alone. Repeated rows and equal ``doc_id`` (null is one) are
packed one after the other, ordered by the hash of their texts, each as a document of its own; very many of
them may be dealt over several ranges. An empty table gives no row. Extra columns are
not read. One partially filled window per range is the only loss at range ends.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from drawfield.llm.common import query, table, text_bytes, tokenizer_path, travels
from drawfield.llm.shingles import pieces
from drawfield.llm.wordtable import word_table

travels(__name__)

WINDOW = 4096
SENTENCE, INSIDE, STRIDE = 8, 40, 32
STRETCH = 192 * WINDOW
RANGE_BYTES = 8 << 20
KNOWN_WORDS = 500_000  # a table of half the size beside what other tasks keep

PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
          "offset long")


def cut(positions, penalties, window):
    """Cheapest cuts of a stretch: indexes into ``positions``, of which the first is 0, the last the end.

    Neighbouring positions are at most ``window`` apart.
    """
    p, extra = positions.tolist(), penalties.tolist()
    value, parent = [0] * len(p), [0] * len(p)
    value[0] = p[0]
    queue, head = [0], 0
    for j in range(1, len(p)):
        low = p[j] - window
        while p[queue[head]] < low:
            head += 1
        parent[j] = queue[head]
        v = value[queue[head]] + window + extra[j]
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
        value[j] = v
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(j)
        j = parent[j]
    return cuts[::-1]


def candidates(ids, ends, is_sentence_end, window):
    """Positions where a stretch may be cut, and what each costs. ``ends``: ends of documents."""
    sentence = np.flatnonzero(is_sentence_end[ids]) + 1
    at = np.unique(np.concatenate([[0, len(ids)], sentence, ends]))
    gaps = np.diff(at)
    stride = min(STRIDE, window)
    wide = np.flatnonzero(gaps > stride)
    if len(wide):
        n = (gaps[wide] - 1) // stride
        start = np.repeat(at[wide], n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        at = np.sort(np.concatenate([at, start + step * stride]))
    cost = np.full(len(at), INSIDE)
    cost[np.isin(at, sentence)] = SENTENCE
    cost[np.isin(at, ends)] = 0
    cost[0] = 0
    return at, cost


class Stream:
    """Packs the documents of one range as they come; holds one stretch of ids at most, or one document."""

    def __init__(self, first_sequence, is_sentence_end, window):
        self.sequence, self.is_end, self.window = first_sequence, is_sentence_end, window
        self.docs, self.held, self.rows = [], 0, []

    def add(self, doc_id, ids):
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= max(STRETCH, 2 * self.window):
            self.flush(last=False)

    def flush(self, last):
        """Cuts what is held. Unless it is the last stretch, the last window stays for the next one."""
        if not self.held:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        at, cost = candidates(ids, ends, self.is_end, self.window)
        cost[-1] = 0
        cuts = at[cut(at, cost, self.window)].tolist()
        if not last:
            cuts.pop()
        begin, k, start_of_doc = 0, 0, 0
        for end in cuts:
            at_doc = begin
            while at_doc < end:
                doc_id, part, before, total = self.docs[k]
                a, b = at_doc - start_of_doc, min(end - start_of_doc, len(part))
                self.rows.append((doc_id, before + a, b - a, part[a:b].tobytes(), total, self.sequence,
                                  at_doc - begin))
                at_doc = start_of_doc + b
                if b == len(part):
                    k, start_of_doc = k + 1, start_of_doc + b
            begin, self.sequence = end, self.sequence + 1
        rest = self.docs[k:]
        if rest:
            doc_id, part, before, total = rest[0]
            gone = begin - start_of_doc
            rest[0] = (doc_id, part[gone:], before + gone, total)
        self.docs, self.held = rest, len(ids) - begin

    def taken(self):
        rows, self.rows = self.rows, []
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs, path, end_id=2, window=WINDOW, range_bytes=RANGE_BYTES, sentence_marks=".!?"):
    """Pieces of documents in windows of at most ``window`` ids, by the word-level tokenizer at ``path``.

    docs: ``doc_id``, ``text``. Returns a row per piece: ``doc_id``, ``start`` (the document's ids
    before it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (with the end id),
    ``sequence_id`` (the window: range number times 2**32 plus a count), ``offset`` in the window.
    """
    _, size = text_bytes(docs)
    ranges = max(1, math.ceil(size / range_bytes))

    def run(batches):
        words = word_table(path, keep_blank=False, most=KNOWN_WORDS)
        vocab = words.tokenizer.get_vocab()
        is_end = np.zeros(max(vocab.values()) + 1, bool)
        is_end[[i for t, i in vocab.items() if t.removesuffix("</w>")[-1:] in sentence_marks]] = True
        stream = Stream(TaskContext.get().partitionId() << 32, is_end, window)
        for batch in batches:
            for some in pieces(batch, 1 << 19):
                ids, counts = words.encode(some["text"])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype("<u4")
                for doc_id, part in zip(some["doc_id"].to_pylist(), np.split(ids, (ends + np.arange(1, len(ends) + 1))[:-1])):
                    stream.add(doc_id, part)
                if len(stream.rows):
                    yield stream.taken()
        stream.flush(last=True)
        yield stream.taken()

    order = ["doc_id", "hash", "number"]
    ordered = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
               .withColumn("number", F.monotonically_increasing_id())
               .repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    return ordered.mapInArrow(run, PIECES)


@query("op8_packing")
def op8_packing(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
