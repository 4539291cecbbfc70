"""Vector code compression: product codes found by walking a trie of distinct parts.

A vector's components become integers ``floor(scale * x)`` and are cut into ``parts`` equal parts. Each
part position has a codebook of ``entries`` entries. A task puts the distinct parts of its rows, with
their counts, into lexicographic order: that order is a trie whose nodes are common prefixes of
dimensions. The trie is walked depth first, ``RUN`` sibling nodes at a time. A node's vector of
distances to all entries is its parent's plus one squared difference, so a prefix that many parts share
is summed once. At a leaf the least distance names the entry, and the part is added to the entry's sum
as often as it occurs.

A round needs no shuffle of parts: every task sends one row per part position and entry (count, sums),
and the driver receives ``parts * entries`` rows. A copied vector costs one leaf a chunk.

Rows whose vector is null or holds a null or non-finite component are dropped. Shorter vectors count as
filled up with zeros to the longest one's length, and all to a multiple of ``parts``. Components count as
at most 2**40 in size after scaling; an error beyond 64 bits is null, and so are sums of errors that hold
one. Rows without ``vec_id`` are kept and come last where ids are ordered; equal ids are ordered by their
vectors. Repeated rows are kept. Fewer rows than ``entries`` give a smaller codebook; a table without
rows to keep gives no row. Extra columns are not read.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from drawfield.llm.common import give_back, query, stored, table, travels

travels(__name__)

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK_VALUES = 1 << 20
RUN = 1024
LARGEST = 1 << 40


class Trie:
    """The distinct rows of ``parts`` in lexicographic order, as runs of common prefixes."""

    def __init__(self, parts):
        order = np.lexsort(parts.T[::-1])
        ordered = parts[order]
        differ = ordered[1:] != ordered[:-1]
        new = np.append(True, differ.any(axis=1))
        starts = np.flatnonzero(new)
        self.leaves = ordered[starts]
        self.count = np.diff(np.append(starts, len(parts)))
        #: For each leaf the first dimension in which it leaves the one before it.
        self.branch = np.append(0, differ.argmax(axis=1)[starts[1:] - 1])
        self.leaf_of = np.empty(len(parts), np.int64)
        self.leaf_of[order] = np.cumsum(new) - 1

    def walk(self, book):
        """``(first leaf, distances)`` of runs of leaves: a row of distances to all entries a leaf."""
        values = self.leaves
        if max(np.abs(values).max(), np.abs(book).max()) >= 1 << 28:
            values, book = values.astype(object), book.astype(object)  # sums of squares leave 64 bits
        nodes = (np.zeros(1, np.int64), np.full(1, len(values)))
        ahead = [(0, *nodes, np.zeros((1, len(book)), values.dtype))]
        while ahead:
            depth, first, last, total = ahead.pop()
            if depth == values.shape[1]:
                yield first[0], total
                continue
            child = first[0] + np.flatnonzero(self.branch[first[0]:last[-1]] <= depth)
            parent = np.searchsorted(first, child, side="right") - 1
            step = values[child, depth][:, None] - book[:, depth]
            total = total[parent] + step * step
            last = np.append(child[1:], last[-1])
            for at in reversed(range(0, len(child), RUN)):
                run = slice(at, at + RUN)
                ahead.append((depth + 1, child[run], last[run], total[run]))

    def nearest(self, book):
        """For each leaf its nearest entry, the first of equals, and the squared distance."""
        entry, error = [], []
        for _, total in self.walk(book):
            best = total.argmin(axis=1)
            entry.append(best)
            error.append(total[np.arange(len(best)), best])
        return np.concatenate(entry), np.concatenate(error)


@dataclass
class Codebooks:
    """``entries[part, entry, place]`` as integers; ``width`` components a part."""

    entries: np.ndarray
    scale: int = SCALE

    @property
    def width(self):
        return self.entries.shape[2]

    def sha256(self):
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def kept(vectors):
    """``vec_id``, ``embedding``, ``label`` of the rows whose vector is whole."""
    def whole(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return (vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
            .filter(F.col("embedding").isNotNull() & F.forall("embedding", whole)))


def _integers(lists, parts, width, scale):
    """An Arrow array of lists as integers ``[row, part, place]``."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    out = np.zeros((len(lists), parts * width), np.int64)
    with np.errstate(over="ignore"):  # the product may pass the largest double; it is cut anyway
        out[np.repeat(np.arange(len(lists)), count), place] = np.clip(np.floor(flat * scale), -LARGEST, LARGEST)
    return out.reshape(len(lists), parts, width)


def _chunks(batches, parts, width, scale):
    most = max(1, CHUNK_VALUES // max(1, parts * width))
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            some = batch.slice(at, most)
            yield some, _integers(some["embedding"], parts, width, scale)


def _sums(rows, books, scale):
    """One training round: ``part``, ``entry``, ``n``, sums of the parts nearest to each used entry."""
    parts, k, width = books.shape

    def run(batches):
        def told():
            part, entry = np.nonzero(count)
            flat = pa.array(total[part, entry].ravel())
            return pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)],
                names=["part", "entry", "n", "sums"])

        count, total, seen = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), 0
        for some, values in _chunks(batches, parts, width, scale):
            for p in range(parts):
                trie = Trie(values[:, p])
                entry, _ = trie.nearest(books[p])
                np.add.at(count[p], entry, trie.count)
                np.add.at(total[p], entry, trie.leaves * trie.count[:, None])
            seen += some.num_rows
            if seen >= 1 << 20:  # sums of so many components stay far below 2**63
                yield told()
                count[:], total[:], seen = 0, 0, 0
        yield told()
        give_back()

    told = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()  # parts * entries rows


def train(vectors, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """``Codebooks`` learnt from all whole vectors, starting from those of the smallest ids; None without any."""
    rows = kept(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = (rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries)
             .select("embedding").toArrow())  # the first `entries` rows
    start = _integers(first["embedding"].combine_chunks(), parts, width, scale)
    books = start.transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for row in _sums(rows, books, scale):
            books[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return Codebooks(books, scale)


def encode(vectors, books):
    """``vec_id``, ``label``, ``code`` (two hex digits a part), ``error`` (squared) of every whole vector."""
    entries, scale = books.entries, books.scale
    parts, _, width = entries.shape
    digits = max(2, len(f"{entries.shape[1] - 1:x}"))

    def run(batches):
        for some, values in _chunks(batches, parts, width, scale):
            code = np.empty((len(values), parts), np.int64)
            error = np.zeros(len(values), object)
            for p in range(parts):
                trie = Trie(values[:, p])
                entry, distance = trie.nearest(entries[p])
                code[:, p] = entry[trie.leaf_of]
                error = error + distance.astype(object)[trie.leaf_of]
            text = ["".join([f"{e:0{digits}x}" for e in row]) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays(
                [some["vec_id"], some["label"], pa.array(text), pa.array([e if e < 1 << 63 else None for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"])
        give_back()

    kind = vectors.schema["label"].dataType.simpleString()
    return kept(vectors).mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def decode(codes, books):
    """``vec_id``, ``embedding``: the middle of each entry's cell, in the place of the original vector."""
    entries, scale = (books.entries.astype(np.float64) + 0.5) / books.scale, books.scale
    digits = max(2, len(f"{entries.shape[1] - 1:x}"))

    def run(batches):
        for batch in batches:
            rows = [[int(c[i:i + digits], 16) for i in range(0, len(c), digits)] for c in batch["code"].to_pylist()]
            values = [np.concatenate([entries[p, e] for p, e in enumerate(row)]) for row in rows]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(values, pa.list_(pa.float64()))],
                                             names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def with_label_error(codes):
    """``codes`` with ``label_error``: the error summed over equal labels, nulls together.

    Sums are combined map-side; the written sums have a known size, so Spark sends them to all tasks
    while that is small and otherwise joins by label with its handling of skewed keys.
    """
    exact = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = stored(codes.groupBy(F.col("label").alias("of_label")).agg(exact.try_cast("long").alias("label_error")), "label-errors")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")


def _sql():
    whole = "embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
    nearest = """SELECT q.vec_id, q.label, q.part, q.v, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.v, c.v)])::BIGINT,
                 e := c.entry)) AS b FROM q JOIN {book} c USING (part) GROUP BY ALL"""
    mean = """SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM {book} c LEFT JOIN (
                SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM (
                    SELECT part, b.e AS entry, i, sum(v[i])::BIGINT AS s, count(*) AS n
                    FROM {near}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM q) + 1)) AS i) GROUP BY ALL)
                GROUP BY ALL) n USING (part, entry)"""
    return f"""
    WITH k AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE {whole}),
    q AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v
         FROM k, (SELECT unnest(range({PARTS})) AS part)),
    c0 AS MATERIALIZED (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM q
         WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})),
    a0 AS MATERIALIZED ({nearest.format(book='c0')}), c1 AS MATERIALIZED ({mean.format(book='c0', near='a0')}),
    a1 AS MATERIALIZED ({nearest.format(book='c1')}), c2 AS MATERIALIZED ({mean.format(book='c1', near='a1')}),
    a2 AS MATERIALIZED ({nearest.format(book='c2')}),
    r AS (SELECT vec_id, label, string_agg(printf('%02x', b.e), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM a2 GROUP BY ALL),
    h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h
    """


@query("op12_vector_codes", _sql())
def op12_vector_codes(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    books = train(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes = with_label_error(stored(encode(vectors, books), "codes"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
