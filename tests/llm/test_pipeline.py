"""The pipeline's stages row by row: ids that repeat or are null, columns with names of the stages' own, empty tables."""

import pytest

import corpus_pipeline


def long_text(x, n=60):
    return " ".join(f"{x}{i}" for i in range(n))


CLASHES = ("doc_id long, text string, toxic_probability double, TOXIC_probability_ double, __text string, __key long, __w int, __b long, "
           "__hit boolean, row string, key long, w int, b long, map map<string,int>, `odd.name` string, features array<string>, "
           "nested struct<doc_id:long,text:string>")


def with_clashes(spark, rows):
    full = [(i, t, 0.7, 0.8, "mine", 5, 6, 7, True, "r", 8, 9, 10, {"a": 1, "b": 2}, "o", ["f"], (3, "n")) for i, t in rows]
    return spark.createDataFrame(full, CLASHES)


@pytest.fixture(scope="module")
def leak(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text


def test_leaks_are_dropped_row_by_row(spark, sf_dir, leak):
    rows = [(None, leak), (2, leak), (2, long_text("clean")), (None, long_text("other")), (3, None), (4, ""), (5, leak + " " + long_text("tail")),
            (6, long_text("again")), (6, long_text("again"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if leak not in (r[1] or "")], key=str)


def test_columns_with_the_stages_own_names_come_back_as_they_were(spark, sf_dir, leak):
    rows = [(1, long_text("a")), (1, long_text("a")), (2, long_text("a") + " more"), (3, leak), (None, long_text("c"))]
    docs = with_clashes(spark, rows)
    want = {(tuple(r)[0], r.text): r for r in docs.collect()}
    left = {corpus_pipeline.drop_toxic: [0, 1, 2, 3, 4], corpus_pipeline.drop_near_copies: [0, 3, 4], corpus_pipeline.drop_contaminated: [0, 1, 2, 4]}
    for stage, stay in left.items():
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema
        got = out.collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((rows[i][0] or 0, rows[i][1]) for i in stay)
        assert all(r == want[r.doc_id, r.text] for r in got)


def test_one_of_rows_equal_in_id_and_text_is_chosen_by_rule(spark, sf_dir):
    docs = spark.createDataFrame([(1, long_text("a"), {"k": n}, n) for n in (5, 3, 4)], "doc_id long, text string, map map<string,int>, n int")
    for parts in (1, 3):
        assert [r.n for r in corpus_pipeline.drop_near_copies(spark, docs.repartition(parts), sf_dir).collect()] == [3]


def test_empty_tables_pass_through(spark, sf_dir):
    docs = with_clashes(spark, []).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
