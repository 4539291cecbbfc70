"""The Jaccard join against all pairs."""

import random
import re

import pytest

from drawfield.llm import jaccard
from drawfield.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                up[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i]:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), smallest[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def made_up(seed):
    """Families of near copies whose links form chains, common passages, repeated and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "é", "THE", "the", "a\x85b", "x　y"]
    passage = rng.choices(vocabulary, k=30)
    rows, texts = [], []
    for family in range(6):
        base = rng.choices(vocabulary, k=rng.choice([9, 40, 120])) + (passage if family % 2 else [])
        for _ in range(rng.choice([1, 4, 14])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"z{rng.randrange(500)}"
            texts.append(rng.choice([" ", "\n", "\t "]).join(words))
            if rng.random() < 0.3:
                base = words
    texts += ["", None, " \n", "one", "One", "one two three", "one two three", "a b c d", "A b c d", "word " * 3000, "word " * 3000]
    rng.shuffle(texts)
    for i, t in enumerate(texts):
        rows.append((i * 3 % 101 + 200 * (i // 101), t))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_pairs(spark, seed):
    rows = made_up(seed)
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n int, set_id string")
    assert sorted(map(tuple, jaccard.join(docs).collect())) == brute(rows)


def test_five_words_and_eighty(spark):
    rows = made_up(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(docs, words=5, percent=80).collect())) == brute(rows, 5, 80)


def test_no_links_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, "v w x y z")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(docs).collect())) == [(1, 2, 1), (2, 0, 2), (3, 2, 3)]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_pivot_that_links_with_nothing(spark):
    """Two texts link with each other, but the pivot of all their lists, a third one, with neither."""
    def words(name, n):
        return [f"{name}{i}" for i in range(n)]
    common, licence = words("c", 123), words("l", 60)
    texts = [common + words("a", 10), common + words("b", 10), common + licence, *[words(x, 400) + licence for x in "xyz"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert [c for _, _, c in want] == [0, 0, 2, 3, 4, 5]
    assert sorted(map(tuple, jaccard.join(docs).collect())) == want


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    got = [tuple(r) for r in jaccard.join(docs).collect()]
    assert sorted(got, key=str) == sorted([(4, 2, 4), (4, 2, 4), (None, 2, 4), (None, 0, None)], key=str)


def test_null_id_joins_two_documents(spark):
    """A set held by null ids alone links with two documents that do not link with each other."""
    words = [f"w{i}" for i in range(100)]
    texts = [(1, [f"a{i}" for i in range(12)] + words), (None, words), (None, words), (2, words + [f"z{i}" for i in range(12)]), (3, ["other", "words", "of", "its", "own"])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    assert [c for _, _, c in brute([(i, " ".join(t)) for i, t in texts if i])] == [1, 2, 3]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (None, 1), (2, 1), (3, 3)], key=str)


def test_sizes_of_hashed_sets():
    texts = [t for _, t in made_up(4)]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]
    assert [len(s) for s in shingle_sets(texts, 5, short="none")] == [
        len(shingles(t, 5)) if len(WORD.findall(t or "")) >= 5 else 0 for t in texts]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, jaccard.op9_jaccard_join(spark, sf_dir).collect())) == brute(rows)
