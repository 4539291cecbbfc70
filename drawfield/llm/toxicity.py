"""Toxicity by a classifier chain: linear models one after the other, each fed the earlier probabilities.

Categories are label columns in a fixed order. The model of category k sees a text's word features and
the probabilities of the categories before it. While training, those probabilities are out-of-fold: each
row's come from models that did not see the row, so later models learn from what they will meet.

Features are the presence of whole words and of word beginnings of four and five letters (lower case).
The ``MOST_FEATURES`` that tell the labels apart best are kept. Training reads at most ``MOST_LABELLED``
labelled rows, those with the smallest hash of ``doc_id`` (a documented bound); scoring covers every row
and its whole text, row by row, without a shuffle.

Null and empty texts, and those without any known feature, get the shares of the training labels: with
mostly clean labels they are clean. Rows with a null ``doc_id`` are scored but cannot be labelled. Repeated labels of a document
count once, the worst one. Repeated documents are scored alike. Without labels nothing is toxic. Extra
columns are not read.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from drawfield.llm.common import give_back, query, stored, table, travels

travels(__name__)

MOST_LABELLED = 8192
MOST_FEATURES = 1024
LEAST_DOCS = 3
FOLDS = 3
STEPS, SHRINK = 200, 0.1
THRESHOLD = 0.3
#: In chain order: what is known of a label row.
CATEGORIES = (("flagged", "toxic = 1 OR quality = 0"), ("low_quality", "quality = 0"), ("toxic", "toxic = 1"))

WORD = re.compile(r"[^\W\d_]+")


def features(text):
    """The distinct features of a text."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words if len(w) > 4}


def _extract(docs):
    def run(batches):
        give_back()
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            found = [sorted(features(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["text"]).columns, pa.array(found, pa.list_(pa.string()))],
                names=[*(c for c in batch.schema.names if c != "text"), "features"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(run, ", ".join(kept) + ", features array<string>")


class Linear:
    """Logistic regression on sparse presence features and a few dense columns."""

    def __init__(self, rows, columns, n_rows, n_columns, dense, y):
        count = np.bincount(columns, minlength=n_columns).astype(float)
        scale = 1 / (0.25 * count + SHRINK)
        dense_scale = 1 / (0.25 * (dense ** 2).sum(axis=0) + SHRINK)
        w, v, b = np.zeros(n_columns), np.zeros(dense.shape[1]), 0.0
        pace = 0.5 / max(1.0, np.sqrt(len(rows) / max(1, n_rows)))
        mw, mv, mb = np.zeros_like(w), np.zeros_like(v), 0.0
        for _ in range(STEPS):
            miss = sigmoid(np.bincount(rows, w[columns], n_rows) + dense @ v + b) - y
            mw = 0.8 * mw + scale * (np.bincount(columns, miss[rows], n_columns) + SHRINK * w)
            mv = 0.8 * mv + dense_scale * (dense.T @ miss + SHRINK * v)
            mb = 0.8 * mb + miss.mean() * 4
            w, v, b = w - pace * mw, v - pace * mv, b - pace * mb
        self.w, self.v, self.b = w, v, b

    def probability(self, rows, columns, n_rows, dense):
        return sigmoid(np.bincount(rows, self.w[columns], n_rows) + dense @ self.v + self.b)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_chain(rows, columns, n_rows, n_columns, labels, folds=FOLDS):
    """Models in chain order and the out-of-fold probabilities. ``labels``: one column a category."""
    fold = np.arange(n_rows) % folds
    before, models = np.zeros((n_rows, 0)), []
    for k in range(labels.shape[1]):
        held_out = np.zeros(n_rows)
        for f in range(folds):
            inside = fold != f
            place = np.cumsum(inside) - 1
            use = inside[rows]
            model = Linear(place[rows[use]], columns[use], int(inside.sum()), n_columns, before[inside], labels[inside, k])
            held_out += np.where(inside, 0, model.probability(rows, columns, n_rows, before))
        models.append(Linear(rows, columns, n_rows, n_columns, before, labels[:, k]))
        before = np.column_stack([before, held_out])
    return models, before


def train(docs, labels, categories=CATEGORIES):
    """``(feature numbers, models, share of each category)`` from labelled documents."""
    worst = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in categories])
    few = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    names = [name for name, _ in categories]
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    rows = stored(_extract(texts.select("text", "doc_id", *names)), "labelled")
    total = rows.agg(F.count(F.lit(1)), *[F.sum(F.col(c).cast("int")) for c in names]).first()
    n = total[0]
    if not n:
        return {}, [], [0.0] * len(names)
    seen = rows.select(F.explode("features").alias("feature"), *names).groupBy("feature").agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(c).cast("int")).alias(c) for c in names])
    worth = F.lit(0.0)
    for c, positive in zip(names, total[1:]):
        share = (positive or 0) / n
        spread = F.sqrt(F.col("docs") * (share * (1 - share) + 1e-6))
        worth = F.greatest(worth, F.abs(F.col(c) - F.col("docs") * share) / spread)
    chosen = seen.filter(F.col("docs") >= LEAST_DOCS).orderBy(worth.desc(), "feature").limit(MOST_FEATURES)
    number = {r[0]: i for i, r in enumerate(chosen.select("feature").collect())}
    known = F.broadcast(docs.sparkSession.createDataFrame(list(number.items()) or [("", 0)], "feature string, i int"))
    used = (rows.select("doc_id", F.explode("features").alias("feature")).join(known, "feature")
            .select("doc_id", "i").toArrow())  # at most MOST_LABELLED documents' chosen features
    label = rows.select("doc_id", *[F.col(c).cast("int").alias(c) for c in names]).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    place = {d: k for k, d in enumerate(label["doc_id"].to_pylist())}
    row = np.array([place[d] for d in used["doc_id"].to_pylist()], np.int64)
    column = used["i"].to_numpy().astype(np.int64)
    y = np.column_stack([label[c].to_numpy() for c in names]).astype(float)
    order = np.lexsort((column, row))
    return number, fit_chain(row[order], column[order], n, len(number) or 1, y)[0], y.mean(axis=0).tolist()


def score(docs, model, categories=CATEGORIES):
    """``docs`` without its text, with ``<category>_probability`` for each category of the chain."""
    number, models, shares = model
    names = [f"{name}_probability" for name, _ in categories]
    keep = [f for f in docs.schema.fields if f.name != "text" and f.name not in names]

    def run(batches):
        give_back()
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            texts = batch["text"].to_pylist()
            found = [[number[f] for f in number.keys() & features(t)] for t in texts]
            columns = np.array([i for f in found for i in f], np.int64)
            rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            before = np.zeros((len(texts), 0))
            for m in models:
                before = np.column_stack([before, m.probability(rows, columns, len(texts), before)])
            before = before if models else np.zeros((len(texts), len(names)))
            before[[not f for f in found]] = shares
            yield pa.RecordBatch.from_arrays(
                [*[batch[f.name] for f in keep], *[pa.array(before[:, k]) for k in range(len(names))]],
                names=[*[f.name for f in keep], *names])
        give_back()

    schema = StructType(keep + [StructField(c, DoubleType()) for c in names])
    return docs.select("text", *[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema)


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("toxic", F.col("toxic_probability") >= THRESHOLD)
