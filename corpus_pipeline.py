"""A corpus pipeline of four stages over ``documents``.

Each stage takes all rows its predecessor kept. The first three return the columns they were given;
packing, the last, returns the pieces of the training sequences.

Rows are told apart by ``doc_id`` and ``text`` (a hash of 64 bits), never by ``doc_id`` alone: two texts with one id are
judged each on its own, and a null ``doc_id`` is a value like others. All columns of a document travel packed in one
struct beside the stage's own columns, so extra columns may have any name and type.
"""

from pyspark.sql import functions as F

from drawfield.llm import decontaminate, jaccard, packing, toxicity
from drawfield.llm.common import bit_map, bit_place, stored, table, tokenizer_path, without_ids


def _key():
    return F.xxhash64("doc_id", "text")


def _rows(docs):
    """``row`` (all columns of a document) and ``key``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key().alias("key"))


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier chain does not call toxic. The chain learns from ``labels`` and the
    labelled ones of the given documents.

    A null or empty text has no feature and gets the share of toxic labels as its probability; repeated rows are
    judged alike, each for itself; without labels every probability is 0 and all rows stay. An empty table gives no row.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return scored.filter(F.col("toxic_probability") < toxicity.THRESHOLD).select("row.*")


def drop_near_copies(spark, docs, sf_dir):
    """One row of each group of near copies, one with the smallest id (a null only where all are null):
    five-word shingles, a similarity of 0.8 or more.

    A text that shares its id with a copy stays, and of rows equal in id and text one stays, the first by all its
    columns as JSON. Documents without words are no copies of each other: only rows with the same id and text are
    one, and all with a null id stay. An empty table gives no row.
    """
    rows = _rows(docs)
    groups = jaccard.join(docs.select(_key().alias("doc_id"), "text"), words=5, percent=80)
    ids = docs.select("doc_id", _key().alias("key")).groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("rows"))
    groups = groups.groupBy(F.col("doc_id").alias("key")).agg(
        F.min("component_id").alias("component"), F.min("n_shingles").alias("n"))
    known = stored(groups.join(ids, "key"), "groups")
    first = known.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("f"))
    first = known.join(first.select("f.key"), "key", "left_semi")
    repeated = stored(first.filter("rows > 1 AND NOT (n = 0 AND id IS NULL)").select("key"), "repeated")
    gone = stored(known.join(first.select("key"), "key", "left_anti").select("key").unionByName(repeated), "copies")
    kept = without_ids(rows, gone, "key").select("row")
    return kept.unionByName(_one_of_each(rows, repeated)).select("row.*")


def _one_of_each(rows, keys):
    """One ``row`` of each key listed. A bit map keeps most other rows from being shuffled."""
    word, bit = bit_place("key")
    marks = F.broadcast(bit_map(keys, "key"))
    some = rows.withColumn("word", word).join(marks, F.col("word") == F.col("w")).filter(F.col("b").bitwiseAND(bit) != 0)
    return (some.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
            .join(keys, "key", "left_semi").select("row"))


def drop_contaminated(spark, docs, sf_dir):
    """Documents that hold no passage of a benchmark item, exact or edited.

    Each row is judged by its own text, whatever id it has or shares; repeated rows go or stay together. Null and
    empty texts stay, and all rows do where ``benchmark`` is empty. An empty table gives no row.
    """
    keyed = docs.select(_key().alias("doc_id"), "text")
    found = stored(decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"))
                   .select(F.col("doc_id").alias("key")).distinct(), "leaked")
    return without_ids(_rows(docs), found, "key").select("row.*")


def pack(spark, docs, sf_dir):
    """The pieces of all documents left, in sequences of at most 4096 ids, ordered by ``doc_id``.

    Null and empty texts are documents of the end id alone; repeated rows, equal and null ids are documents of their
    own, side by side. An empty table gives no row; other columns are not read.
    """
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("packing", pack)]

#: SQL cannot train the classifier or encode texts; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order, each one's rows written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
