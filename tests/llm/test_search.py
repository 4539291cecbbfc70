"""BM25 search against scoring every document."""

import math
import random
import re

import pytest

import oracle
from drawfield.llm import search

TERM = re.compile("[0-9a-z\x80-\U0010ffff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, queries, k):
    bags = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in rows if i is not None]
    n = len(bags)
    mean = sum(len(b) for _, b in bags) / n
    df = {}
    for _, bag in bags:
        for term in set(bag):
            df[term] = df.get(term, 0) + 1
    out = []
    for q, text in queries:
        scored = []
        for i, bag in bags:
            total = 0
            for term in set(TERM.findall((text or "").translate(LOWER))):
                tf = bag.count(term)
                if tf:
                    idf = math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5))
                    total += round(idf * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(bag) / mean)) * search.SCALE)
            if total:
                scored.append((-total, i))
        out += [(q, r + 1, i, -s / search.SCALE) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def made_up(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.choice([1, 5, 30, 90])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "É é THE The"), (n + 3, "w1 " * 4000), (n + 4, rows[3][1]), (n + 5, rows[3][1]), (None, "w1 w2")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, k", [(1, 10), (2, 1), (3, 500)])
def test_equals_scoring_everything(spark, monkeypatch, seed, k):
    rows = made_up(seed)
    monkeypatch.setattr(search, "SHARD_POSTINGS", 900)      # many shards
    monkeypatch.setattr(search, "COMMON", 8)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(3)
    queries = [(i, t) for i, t in rows if i is not None and i % 9 == 0] + [(-1, "unknown words"), (-2, None)]
    found = search.search(search.build_index(docs), spark.createDataFrame(queries, "query_id long, text string"), k)
    assert sorted(map(tuple, found.collect())) == brute(rows, queries, k)


def test_query_blocks_change_nothing(spark, monkeypatch):
    rows = made_up(5, 80)
    queries = [(i, t) for i, t in rows if i is not None and i % 5 == 0]
    monkeypatch.setattr(search, "QUERY_BYTES", 700)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = search.search(search.build_index(docs), spark.createDataFrame(queries, "query_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute(rows, queries, 10)


def test_repeated_query_rows_are_one_query(spark):
    rows = made_up(6, 80)
    queries = [(i, t) for i, t in rows if i is not None and i % 7 == 0]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = search.build_index(docs)
    halves = [(i, part) for i, t in queries for words in [(t or "").split()] for part in (" ".join(words[::2]), " ".join(words[1::2]))]
    once, twice, split = (sorted(map(tuple, search.search(index, spark.createDataFrame(q, "query_id long, text string")).collect()))
                          for q in (queries, queries * 2, halves))
    assert once == twice == split and len(once) > 10


def test_blocks_below_the_threshold_are_skipped():
    """What is skipped cannot be among the best, and the threshold does skip."""
    import numpy as np
    rng = np.random.default_rng(1)
    n = 3205
    lengths = rng.integers(5, 60, n).astype(np.int32)
    held = [np.sort(rng.choice(n, size, False)) for size in (n, n // 2, 40, 7)]
    docs = np.concatenate(held).astype(np.int32)
    row = dict(doc_ids=np.arange(n).tobytes(), lengths=lengths.tobytes(), terms=np.arange(4, dtype=np.uint64).tobytes(),
               starts=np.cumsum([0, *map(len, held)]).tobytes(), docs=docs.tobytes(), tfs=rng.integers(1, 5, len(docs)).astype(np.int32).tobytes())
    shard = search.Shard(row, np.arange(4, dtype=np.uint64), np.array([0.1, 0.7, 4.0, 6.0]), lengths.mean())
    everything = np.bincount(shard.docs, shard.value, n)
    order = np.lexsort((np.arange(n), -everything))[:5]
    for floor in (1.0, everything[order[4]]):
        numbers, scores = shard.best(np.arange(4), 5, floor)
        assert sorted(numbers) == sorted(order) and sorted(scores) == sorted(everything[order])
    assert len(shard.best(np.arange(4), 5, everything.max() + 1)[0]) == 0
    numbers, scores = shard.best(np.arange(4), 5, few=20)
    assert (scores == everything[numbers]).all() and min(scores) <= everything[order[4]]


def test_rows_blocks_and_batches_change_nothing(spark, monkeypatch):
    """Small blocks, ranges and batches: common terms in rows, floors from the first shards, sums beyond single precision."""
    rows = made_up(7, 260)
    for name, value in dict(BLOCK=8, RANGE=2, COMMON=4, SHARD_DOCS=70, FIRST=3, CELLS=2000).items():
        monkeypatch.setattr(search, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    queries = [(i, t) for i, t in rows if i is not None and i % 6 == 0]
    index = search.build_index(docs)
    assert {r.first for r in index.select("first").collect()} == {True, False}
    for k, exact in ((3, search.EXACT), (20, search.EXACT), (10, 20_000)):
        monkeypatch.setattr(search, "EXACT", exact)
        found = search.search(index, spark.createDataFrame(queries, "query_id long, text string"), k)
        assert sorted(map(tuple, found.collect())) == brute(rows, queries, k)


def test_a_shard_is_opened_once_for_a_block_of_queries(spark, monkeypatch, tmp_path):
    """The threshold comes from some of the shards, whose answers are kept, not from a pass of its own over all."""
    class Counted(search.Shard):
        def __init__(self, *args):
            import uuid
            (tmp_path / uuid.uuid4().hex).touch()
            super().__init__(*args)

    monkeypatch.setattr(search, "SHARD_DOCS", 20)
    rows = made_up(8, 200)
    index = search.build_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    queries = [(i, t) for i, t in rows if i is not None and i % 9 == 0]
    monkeypatch.setattr(search, "Shard", Counted)
    found = search.search(index, spark.createDataFrame(queries, "query_id long, text string"))
    assert sorted(map(tuple, found.collect())) == brute(rows, queries, 10)
    assert len(list(tmp_path.iterdir())) == index.count() > 5


def test_values_beyond_the_bits_of_a_posting():
    import numpy as np
    rng = np.random.default_rng(2)
    n = 9000
    held = [np.sort(rng.choice(n, size, False)) for size in (n, 900, 300, 7)]
    docs = np.concatenate(held).astype(np.int32)
    row = dict(doc_ids=np.arange(n).tobytes(), lengths=rng.integers(5, 60, n).astype(np.int32).tobytes(), terms=np.arange(4, dtype=np.uint64).tobytes(),
               starts=np.cumsum([0, *map(len, held)]).tobytes(), docs=docs.tobytes(), tfs=rng.integers(1, 5, len(docs)).astype(np.int32).tobytes())
    shard = search.Shard(row, np.arange(4, dtype=np.uint64), np.array([0.1, 20.0, 45.0, 300.0]), 30.0)
    everything = np.bincount(shard.docs, shard.value, n)
    for k in (1, 40, 1200):
        order = np.lexsort((np.arange(n), -everything))[:k]
        numbers, scores = shard.best(np.arange(4), k, everything[order[-1]])
        assert numbers.tolist() == order.tolist() and (scores == everything[order]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = some.withColumnRenamed("doc_id", "query_id")
    assert search.search(search.build_index(none), asked).count() == 0
    assert search.search(search.build_index(some), asked.limit(0)).count() == 0


def test_query(spark, sf_dir):
    assert oracle.compare(search.op1_topk_search(spark, sf_dir), oracle.connect(sf_dir), search.SQL) is None
