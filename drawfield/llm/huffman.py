"""Token ids on disk: canonical length-limited Huffman codes from global counts.

A written set of ids is a folder with three tables:

``code``    ``id``, ``length``: the code. Codes are canonical, so lengths are all that is stored.
``blocks``  independent blocks of whole documents in ascending ``doc_id``: ``file_no``, ``block_no``,
            ``first`` (ids before the block in its file), ``doc_ids``, ``counts`` (ids per document),
            ``payload`` (each document starts at a whole byte), ``marks`` (bits between checkpoints:
            one at each document's start and after every ``EVERY`` ids inside it).
``files``   ``file_no``, ``first`` (ids before the file), ``ids``.

Readers decode a block on its own: all its checkpoints advance together, one table look-up an id.

Null and empty texts are documents of the end id alone. Repeated rows and equal ``doc_id`` are kept,
one after the other. An empty table gives a set without blocks. Extra columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from drawfield.llm.common import query, stored, table, text_bytes, tokenizer_path, travels
from drawfield.llm.shingles import pieces
from drawfield.llm.wordtable import word_table
from drawfield.session import shared_dir

travels(__name__)

LONGEST = 18
EVERY = 256
BLOCK = 1 << 18
FILE_BYTES = 8 << 20


# --- the code --------------------------------------------------------------------------

def code_lengths(counts, longest=LONGEST):
    """Optimal lengths of at most ``longest`` bits for positive ``counts``, by package-merge."""
    counts = np.asarray(counts, np.int64)
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << longest:
        raise ValueError(f"{n} ids do not fit into codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order]
    levels, items = [], leaves
    is_leaf = np.ones(n, bool)
    for _ in range(longest):
        levels.append(is_leaf)
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        items, is_leaf = both[rank], rank < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[order[:used]] += 1
        take = 2 * (take - used)
    return lengths


def canonical(ids, lengths):
    """Codes by (length, id)."""
    ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
    order = np.lexsort((ids, lengths))
    codes, code, before = np.zeros(len(ids), np.uint64), 0, 0
    for k in order.tolist():
        length = int(lengths[k])
        code <<= length - before
        codes[k], before = code, length
        code += 1
    return codes


class Code:
    def __init__(self, ids, lengths):
        ids, lengths = np.asarray(ids, np.int64), np.asarray(lengths, np.int64)
        codes = canonical(ids, lengths)
        size = int(ids.max(initial=0)) + 1
        self.codes, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.codes[ids], self.lengths[ids] = codes, lengths.astype(np.uint64)
        self.width = int(lengths.max(initial=1))
        order = np.lexsort((ids, lengths))
        entries = ids[order] << 5 | lengths[order]
        table = np.repeat(entries, 1 << (self.width - lengths[order]))
        self.table = np.zeros(1 << self.width, np.int64)
        self.table[:len(table)] = table

    def encode(self, ids, counts):
        """``(payload, bytes of each document, marks)`` of documents whose ids lie one after the other."""
        counts = np.asarray(counts, np.int64)
        length = self.lengths[ids].astype(np.int64)
        end = np.cumsum(length)
        first = np.cumsum(counts) - counts
        start = end - length
        whole = start[first]
        size = (np.append(whole[1:], end[-1]) - whole + 7) // 8
        base = np.cumsum(size) - size
        at = start + np.repeat(base * 8 - whole, counts)
        shift = (64 - (at & 31) - length).astype(np.uint64)
        value = self.codes[ids] << shift
        word = at >> 5
        n = int(base[-1] + size[-1] + 3) // 4 + 1
        # Codes do not overlap, so their sum is their union; sums below 2**32 are exact in doubles.
        words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
        words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
        payload = words.astype(np.int64).astype(">u4").tobytes()[:int(base[-1] + size[-1])]
        marks = at[_checkpoints(counts)]
        return payload, size, np.diff(marks, append=8 * len(payload)).astype("<u4").tobytes()

    def decode(self, payload, counts, marks):
        """The ids of a block, in order."""
        counts = np.asarray(counts, np.int64)
        steps = np.frombuffer(marks, "<u4").astype(np.int64)
        lanes = (counts + EVERY - 1) // EVERY
        each = np.full(int(lanes.sum()), EVERY)
        each[np.cumsum(lanes) - 1] = counts - (lanes - 1) * EVERY
        order = np.argsort(-each, kind="stable")
        at = (np.cumsum(steps) - steps)[order]
        active = np.searchsorted(-each[order], -np.arange(EVERY), side="left")
        raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.int64)
        ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty((EVERY, len(each)), np.uint32)
        drop, mask = 32 - self.width, (1 << self.width) - 1
        for step in range(int(each.max(initial=0))):
            k = active[step]
            pos = at[:k]
            entry = self.table[ahead[pos >> 3] >> (drop - (pos & 7)) & mask]
            out[step, :k] = entry >> 5
            pos += entry & 31
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(EVERY) < each[:, None]]


def _checkpoints(counts):
    """Positions among a block's ids where decoding may begin."""
    lanes = (counts + EVERY - 1) // EVERY
    first = np.repeat(np.cumsum(counts) - counts, lanes)
    return first + EVERY * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))


# --- writing and reading ---------------------------------------------------------------

TOKENS = ("file_no int, block_no int, first long, doc_ids array<long>, counts array<long>, ids binary, "
          "tally array<struct<id:long,n:long>>")


def tokenize(docs, path, end_id):
    """Blocks of the ids (little-endian, 16 bits each) of ``docs``, in their order in each partition: a text's ids and
    the end id. A partition's last row has a ``tally`` instead: how often each id occurs in it."""
    def run(batches):
        words = word_table(path, keep_blank=True)
        file_no, block_no, first, held, n = TaskContext.get().partitionId(), 0, 0, [], 0
        tally = np.zeros(1 << 16, np.int64)

        def row(*values):
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((file_no, *values), (
                    pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
                    pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))))],
                names=["file_no", "block_no", "first", "doc_ids", "counts", "ids", "tally"])

        def block():
            doc_ids, counts, ids = zip(*held)
            return row(block_no, first, [i for some in doc_ids for i in some], np.concatenate(counts), b"".join(ids), None)

        for batch in batches:
            for some in pieces(batch, 1 << 19):
                ids, counts = words.encode(some["text"])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                tally += np.bincount(ids, minlength=1 << 16)
                held.append((some["doc_id"].to_pylist(), counts + 1, ids.tobytes()))
                n += len(ids)
                if n >= BLOCK:
                    yield block()
                    block_no, first, held, n = block_no + 1, first + n, [], 0
        if held:
            yield block()
        seen = np.flatnonzero(tally)
        yield row(None, None, None, None, None, [{"id": i, "n": c} for i, c in zip(seen.tolist(), tally[seen].tolist())])
    return docs.mapInArrow(run, TOKENS)


def write_ids(docs, path, tokenizer, end_id=2, file_bytes=FILE_BYTES):
    """Encode all texts and write them below ``path`` in the format above.

    Texts are dealt into files by ranges of ``doc_id``; equal ids (and nulls) may be dealt over several by the hash of
    the text and a number. Only texts are shuffled, tokenized once in their final order.
    """
    spark = docs.sparkSession
    _, size = text_bytes(docs)
    files = max(1, math.ceil(size / file_bytes))
    order = ["doc_id", "hash", "number"]
    ordered = (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))
               .withColumn("number", F.monotonically_increasing_id())
               .repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    tokens = stored(tokenize(ordered, tokenizer, end_id), "tokens")
    rows = (tokens.filter("tally IS NOT NULL").select(F.explode("tally").alias("t"))
            .groupBy("t.id").agg(F.sum("t.n")).orderBy("id").collect())  # a row per id of the vocabulary
    ids, lengths = [r[0] for r in rows], code_lengths([r[1] for r in rows]).tolist()
    (spark.createDataFrame(list(zip(ids, lengths)), "id long, length long").coalesce(1)
     .write.parquet(f"{path}/code"))
    code = Code(ids, lengths)

    def encode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                some = batch.slice(i, 1)
                ids = np.frombuffer(some["ids"][0].as_buffer(), "<u2")
                payload, _, marks = code.encode(ids, some["counts"].flatten().to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [*[some[c] for c in ("file_no", "block_no", "first", "doc_ids", "counts")],
                     pa.array([payload], pa.binary()), pa.array([marks], pa.binary())],
                    names=["file_no", "block_no", "first", "doc_ids", "counts", "payload", "marks"])

    blocks = tokens.filter("ids IS NOT NULL").drop("tally")
    (blocks.mapInArrow(encode, "file_no int, block_no int, first long, doc_ids array<long>, counts array<long>, "
                               "payload binary, marks binary")
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))
    per_file = (blocks.select("file_no", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
                .groupBy("file_no").agg(F.sum("n")).orderBy("file_no").collect())  # a row per file
    first, listed = 0, []
    for file_no, n in per_file:
        listed.append((file_no, first, n))
        first += n
    (spark.createDataFrame(listed, "file_no int, first long, ids long").coalesce(1)
     .write.parquet(f"{path}/files"))


def read_ids(spark, path):
    """Documents of a written set: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids``
    (little-endian unsigned 32-bit)."""
    rows = spark.read.parquet(f"{path}/code").collect()  # a row per id of the vocabulary
    code = Code([r["id"] for r in rows], [r["length"] for r in rows])
    base = {r[0]: r[1] for r in spark.read.parquet(f"{path}/files").select("file_no", "first").collect()}

    def decode(batches):
        for batch in batches:
            for file_no, first, doc_ids, counts, payload, marks in zip(*(
                    batch[c].to_pylist() for c in ("file_no", "first", "doc_ids", "counts", "payload", "marks"))):
                ids = code.decode(payload, counts, marks)
                counts = np.array(counts, np.int64)
                ends = np.cumsum(counts)
                parts = [ids[e - c:e].astype("<u4").tobytes() for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base[file_no] + first + ends - counts),
                     pa.array(counts), pa.array(parts, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return (spark.read.parquet(f"{path}/blocks")
            .select("file_no", "first", "doc_ids", "counts", "payload", "marks")
            .mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary"))


@query("op7_token_ids")
def op7_token_ids(spark, sf_dir):
    path = shared_dir(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
