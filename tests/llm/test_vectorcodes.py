"""Vector codes against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from drawfield.llm import vectorcodes


def brute(rows, parts, entries, rounds, scale=256):
    """``{row number: (code, error)}`` and the codebooks, by loops over Python integers."""
    whole = [(i, v, x) for i, (v, x, _) in enumerate(rows) if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    width = max(1, -(-max((len(x) for _, _, x in whole), default=0) // parts))
    cut = {}
    for i, _, x in whole:
        full = [max(-2**40, min(2**40, math.floor(c * scale))) for c in x] + [0] * (parts * width - len(x))
        cut[i] = [full[p * width:(p + 1) * width] for p in range(parts)]
    first = sorted(whole, key=lambda r: (r[1] is None, r[1] or 0, r[2]))[:entries]
    books = [[list(cut[i][p]) for i, _, _ in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for i in cut:
                members.setdefault(nearest(cut[i][p], books[p])[1], []).append(cut[i][p])
            for k, some in members.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    out = {}
    for i in cut:
        found = [nearest(cut[i][p], books[p]) for p in range(parts)]
        out[i] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
    return out, books


def table_of(spark, rows):
    return spark.createDataFrame([(v, x, lab, "x", 3) for v, x, lab in rows],
                                 "vec_id long, embedding array<double>, label int, code string, error int")


def vectors(seed, n, size):
    rng = random.Random(seed)
    rows = [(i if i % 17 else None, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.2)]) for _ in range(size)], rng.choice([None, 0, 1, 2]))
            for i in range(n)]
    rows += [rows[1]] * 40 + [(rows[3][0], rows[4][1], 1)]
    rows += [(900, None, 1), (901, [0.1, None] + [0.0] * (size - 2), 1), (902, [float("nan")] + [0.0] * (size - 1), 2),
             (903, [float("inf")] + [0.0] * (size - 1), 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, size, more", [
    (1, 12, []), (2, 8, [(950, [0.3], 0), (951, [], None), (952, [1.0] * 11, 1)]),
    (3, 8, [(960, [1e7] * 8, 5), (961, [-3e6] * 8, 5), (962, [1e30, -1e300] + [0.0] * 6, 6)])])
def test_equals_loops(spark, seed, size, more):
    rows = vectors(seed, 150, size) + more
    want, want_books = brute(rows, 4, 10, 2)
    frame = table_of(spark, rows)
    books = vectorcodes.train(frame, parts=4, entries=10)
    assert books.entries.tolist() == want_books
    assert books.sha256() == hashlib.sha256(",".join(str(c) for b in want_books for e in b for c in e).encode()).hexdigest()
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in vectorcodes.encode(frame, books).collect()), key=repr)
    assert got == sorted(((rows[i][0], rows[i][2], c, e if e < 2**63 else None) for i, (c, e) in want.items()), key=repr)


def test_label_errors(spark):
    codes = spark.createDataFrame([(1, 7, 5), (2, 7, 6), (3, None, 1), (4, None, 2), (5, 8, None), (6, 8, 4), (7, 9, 2**62), (8, 9, 2**62)],
                                  "vec_id long, label int, error long")
    got = {r.vec_id: r.label_error for r in vectorcodes.with_label_error(codes).collect()}
    assert got == {1: 11, 2: 11, 3: 3, 4: 3, 5: None, 6: None, 7: None, 8: None}


def test_nothing_to_keep(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(1, None, 2)]):
        frame = spark.createDataFrame(rows, schema)
        assert vectorcodes.train(frame) is None
        path = str(tmp_path / f"{len(rows)}")
        frame.write.parquet(f"{path}/embeddings.parquet")
        assert vectorcodes.op12_vector_codes(spark, path).collect() == []


def test_trie_shares_prefixes_and_visits_every_leaf_once():
    rng = np.random.default_rng(5)
    parts = rng.integers(-3, 4, (4000, 5))
    trie = vectorcodes.Trie(parts)
    assert (trie.leaves[trie.leaf_of] == parts).all() and trie.count.sum() == len(parts)
    book = rng.integers(-3, 4, (9, 5))
    seen = np.zeros(len(trie.leaves), int)
    for first, total in trie.walk(book):
        run = slice(first, first + len(total))
        seen[run] += 1
        assert (total == ((trie.leaves[run][:, None] - book) ** 2).sum(axis=2)).all()
    assert (seen == 1).all()


def test_decoded_vectors_are_near(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vectorcodes.train(frame)
    back = {r.vec_id: np.array(r.embedding) for r in vectorcodes.decode(vectorcodes.encode(frame, books), books).collect()}
    rows = {r.vec_id: np.array(r.embedding) for r in frame.collect()}
    lost = sum(((rows[i] - back[i]) ** 2).sum() for i in rows) / sum((v ** 2).sum() for v in rows.values())
    assert set(back) == set(rows) and lost < 0.5
