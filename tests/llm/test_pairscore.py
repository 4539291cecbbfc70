"""Ranked search against scoring every document."""

import math
import random
import re

import numpy as np
import pytest

from drawfield.llm import pairscore

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    queries, out = {}, []
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    for item, wanted in queries.items():
        found = []
        for doc_id, b in bags:
            m = 50 + (50 * len(b) * n_docs) // n_words if b else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b.count(t)) // (1000 * b.count(t) + 20 * m))
                        for t in wanted & set(b))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, k):
    index = pairscore.build_index(docs)
    log, pairs = pairscore.build_pairs(index, items)
    found = pairscore.search(log, pairs, index.filter("term IS NULL").count(), k)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made_up(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["É", "é", "THE", "the", "日本", "a_b", "x-y"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, odds, k=rng.choice([1, 5, 30, 90])))) for i in range(n)]
    docs += [docs[3]] * 5 + [(None, docs[4][1]), (None, None), (7000, ""), (7001, " .,;"), (7002, "the " * 9000), (7003, docs[9][1])]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, odds, k=rng.choice([1, 3, 12, 40])))) for i in range(12)]
    items += [items[0], (1, "w7 w8 w9"), (None, "w3 w5"), (None, "w4"), (50, None), (51, ""), (52, "never seen"), (53, "日本 the")]
    return docs, items


@pytest.mark.parametrize("seed, k, postings, block", [(1, 5, 1 << 20, 100_000), (2, 50, 300, 100_000), (3, 3, 100, 20), (4, 1000, 700, 60)])
def test_equals_full_scoring(spark, monkeypatch, seed, k, postings, block):
    monkeypatch.setattr(pairscore, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(pairscore, "BLOCK_TERMS", block)
    docs, items = made_up(seed, 300)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, q int, block int")
    assert searched(frame, asked, k) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert searched(docs, items, 5) == []
    assert searched(some, items.limit(0), 5) == []
    assert searched(some, spark.createDataFrame([(1, "zz")], "item_id long, text string"), 5) == []
    assert searched(spark.createDataFrame([(1, None)], "doc_id long, text string"), items, 5) == []


def test_pair_bounds_skip_documents_that_single_bounds_read():
    """Two common terms that never meet: as a pair they bound half as much, and no document is a candidate."""
    ids = list(range(200))
    group = {"shard": 0, "block": 0}
    impact = np.full(200, 10)
    row = {"ids": ids, "queries": [5], "starts": [0, 3], "terms": [0, 1, 2], "weights": [1, 1, 1], "lists": [0, 100, 200, 202],
           "docs": np.concatenate([np.arange(0, 200, 2), np.arange(1, 200, 2), [6, 7]]), "ratios": [*impact, 30, 30],
           "pair_a": [0, 0, 1], "pair_b": [1, 2, 2], "pair_most": [0, 40, 40], "pair_starts": [0, 0, 1, 2],
           "pair_docs_a": [3, 3], "pair_docs_b": [0, 1]}
    row = {c: v if c == "ids" else np.asarray(v).astype(pairscore._KINDS[c]).tobytes() for c, v in row.items()} | group
    shard = pairscore.Shard(row)
    units = shard.units([0, 1, 2])
    assert [u[0] for u in units] == [10, 30] and units[0][1] == (0, 1)
    docs, score = shard.best(0, 5, 31)
    assert docs.tolist() == [6, 7] and score.tolist() == [40, 40]
    assert shard.best(0, 5, 41)[0].tolist() == []
