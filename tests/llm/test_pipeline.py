import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_stages_one_by_one(spark):
    import corpus_pipeline as c
    from snapforge.llm import mixing, quality
    from snapforge.llm.common import written
    from tests.llm.test_duplicates import brute_lines, components
    from tests.llm.test_near_duplicates import brute_sets, jaccard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # quality: what is kept scores 0.7 or more, and clean documents stay
    kept = written(c.quality_stage(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels, "quality", ~quality.held_out(F.col("doc_id")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).where("score >= 0.7").collect()}
    # lines: as by brute force, without texts of which nothing is left
    lines = written(c.line_stage(spark, kept, SF), "t")
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert {r.doc_id: r.text for r in lines.collect()} == {i: t for i, t in want.items() if t.strip(" ")}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    # near duplicates: one document of each group by the Jaccard similarity of all pairs
    near = written(c.near_duplicate_stage(spark, lines, SF), "t")
    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    sets = brute_sets(t for _, t in rows)
    label = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    assert sorted(r.doc_id for r in near.collect()) == sorted({rows[i][0] for i in label})
    # mixing: whole rows, in the sum of the targets
    mixed = written(c.mixing_stage(spark, near, SF), "t")
    assert mixed.columns == docs.columns and mixed.exceptAll(mixed.join(near.select("doc_id"), "doc_id", "left_semi").select(*mixed.columns)).count() == 0
    n = lambda df: df.agg(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert abs(n(mixed) / n(near) - 1.5) < 0.2
    # encoding: everything comes back
    coded = c.encoding_stage(spark, mixed, SF).collect()
    assert len(coded) == mixed.count() and all(r.round_trip for r in coded)


def test_run(spark):
    import corpus_pipeline as c

    assert c.run(spark, SF).where("not round_trip").count() == 0


def test_stages_over_odd_rows(spark, odd, docs):
    import corpus_pipeline as c

    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i))
    empty = docs([])
    for name, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
    judged = c.quality_stage(spark, odd, SF)
    assert set(map(tuple, judged.collect())) <= set(map(tuple, odd.collect())) and judged.columns == odd.columns
    # of row 2 nothing is left; both copies of 5 have one text
    cut = c.line_stage(spark, odd, SF)
    assert ids(cut) == [None, 1, 3, 4, 5, 5, 6, 7] and all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    # texts without words stay, of 5 one does
    assert ids(c.near_duplicate_stage(spark, odd, SF)) == [None, 1, 2, 3, 4, 5, 6, 7]
    mixed = c.mixing_stage(spark, odd, SF)
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, odd.collect())) and mixed.count() > 0
    coded = c.encoding_stage(spark, odd, SF).collect()
    assert len(coded) == odd.count() and all(r.round_trip for r in coded) and {r.doc_id: r.n_tokens for r in coded}[1] == 0


def test_all_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_bpe", "op2_embedding_dedup", "op5_simhash", "op6_quality", "op7_substring", "op8_media", "op9_line_dedup", "op10_token_binary"])
def test_registered_queries_over_whole_tables(spark, name):
    import __spark_entry__ as e

    key, table = ("vec_id", "embeddings") if name == "op2_embedding_dedup" else ("doc_id", "documents")
    got = [r[key] for r in e.queries()[name](spark, SF).select(key).collect()]
    assert sorted(got) == sorted(r[key] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_mixing"])
def test_sql(spark, name):
    import duckdb
    from snapforge.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).fetchall()
    df = queries.QUERIES[name](spark, SF)
    cols = [c[0] for c in con.description]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*cols).collect())
