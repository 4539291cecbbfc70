"""Circulant MinHash against all pairs."""

import random

import numpy as np
import pytest

from drawfield.llm import circulant
from drawfield.llm.shingles import shingle_sets
from test_jaccard import brute, made_up


def with_kept(rows):
    return [(*r, r[0] == r[2]) for r in rows]


def found(spark, rows, **how):
    frame = spark.createDataFrame([(i, t, i, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    return sorted(tuple(r) for r in circulant.near_duplicates(frame, **how).collect())


@pytest.mark.parametrize("seed, small", [(1, 24), (2, 2), (3, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, small):
    """With few sets a bucket, most pairs come by way of the prefixes."""
    monkeypatch.setattr(circulant, "SMALL", small)
    rows = made_up(seed)
    assert found(spark, rows) == with_kept(brute(rows, 3, 85))


def test_other_shingles_and_percent(spark):
    rows = made_up(7)
    assert found(spark, rows, words=5, percent=80) == with_kept(brute(rows, 5, 80))


def test_chain_without_a_middle_and_a_passage_in_all(spark, monkeypatch):
    """Copies of copies link in a chain only; a passage that all texts share makes one bucket of everything."""
    monkeypatch.setattr(circulant, "SMALL", 4)
    rng = random.Random(3)
    passage, rows = [f"p{i}" for i in range(70)], []
    for chain in range(6):
        words = [f"c{chain}w{i}" for i in range(100)]
        for step in range(12):
            words[rng.randrange(100)] = f"n{chain}x{step}"
            rows.append((len(rows), " ".join(words + passage)))
    rows += [(len(rows) + i, " ".join(passage + [f"z{i}y{j}" for j in range(60)])) for i in range(40)]
    assert found(spark, rows) == with_kept(brute(rows, 3, 85))


def test_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (4, text + " x"), (2, text + " y"), (None, "only null here now"), (None, None), (9, ""), (9, "")]
    got = sorted((tuple(r) for r in circulant.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 58, 2, False), (4, 59, 2, False), (2, 59, 2, True), (None, 2, None, True), (None, 0, None, True),
                          (9, 0, 9, True), (9, 0, 9, True)], key=repr)
    assert circulant.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_signatures_are_minima_over_one_shifted_permutation():
    circle = circulant.Circulant(64)
    tokens = shingle_sets([" ".join(f"w{i}" for i in range(5000))], 3)[0]
    assert sorted(circle.ring[:circulant.UNIVERSE].tolist()) == list(range(circulant.UNIVERSE))
    place = circle.place[(tokens >> np.uint64(11)) & np.uint64(circulant.UNIVERSE - 1)].astype(np.int64)
    want = [circle.ring[(place + k) % circulant.UNIVERSE].min() for k in range(64)]
    assert circle.signature(tokens).tolist() == want


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(8)
    circle, gaps = circulant.Circulant(384), []
    for share in (50, 150, 260):
        for _ in range(10):
            a, b = (np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
            b = np.unique(np.append(a[:share], b[share:]))
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            gaps.append((circle.signature(a) == circle.signature(b)).mean() - truth)
    assert abs(np.mean(gaps)) < 0.02 and np.max(np.abs(gaps)) < 0.12
