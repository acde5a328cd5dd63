"""The stages on small documents, and the queries with SQL against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from hunkline.llm.queries import QUERIES, SQL
from tests.llm.cases import SCHEMA, documents, prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with planted cases: toxic texts, repeated passages, near copies,
    benchmark passages."""
    d = str(tmp_path_factory.mktemp("tables"))
    passage = "\n".join(prose(5000 + i, 20) for i in range(4))
    rows = []
    for i in range(300):
        text = prose(i, 60)
        if i % 5 == 0:
            text += " horridus vilestus wretchum horridum"
        if i % 50 == 7:
            text += "\n" + passage
        if i % 50 == 8:
            text = rows[-1][1].replace(passage, "") + " x"
        if i % 50 == 9:
            text += " " + prose(9000, 20)
        rows.append((i, text, "en", "s", len(text)))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, prose(9000, 20))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_takes_effect_and_keeps_clean_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == docs.columns, name
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r.doc_id for r in k.collect()} for k in kept]
    toxic = {i for i in range(300) if i % 5 == 0}
    assert len(toxic & ids[1]) <= 2 and len((ids[0] - toxic) - ids[1]) <= 6
    texts = {r.doc_id: r for r in kept[2].collect()}
    assert ids[2] == ids[1] and all(r.n_chars == len(r.text) for r in texts.values())
    with_passage = [i for i in sorted(ids[2]) if i % 50 == 7]
    assert [prose(5001, 20) in texts[i].text for i in with_passage] == [i == with_passage[0] for i in with_passage]
    # near copies of i % 50 == 7 whose original is there go; benchmark passages go; the rest stays
    assert ids[3] - ids[4] == {i for i in ids[3] if i % 50 == 9}
    assert ids[2] - ids[3] <= {i for i in range(300) if i % 50 == 8} and len(ids[2] - ids[3]) >= 4
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} == ids[4] and all(len(r.ids) == r.n_tokens for r in rows)


def test_stages_on_the_defined_cases(spark, folder):
    docs = spark.createDataFrame(documents(), SCHEMA)
    for source in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, source, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            rows = out.collect()
            assert name == "toxicity" or {r.doc_id for r in rows} >= ({None} if source is docs else set())


def test_line_dedup_keeps_other_columns_and_drops_blank_leftovers(spark):
    lines = "\n".join(prose(i, 5) for i in range(4))
    rows = [(1, lines, 10, True, None), (2, lines + "\n\n \t", 20, False, "x"), (3, lines + "\nits own line", 30, None, "y"), (4, "\n\n", 40, None, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, N_Lines int, N_REMOVED boolean, C0 string")
    out = corpus_pipeline.line_dedup(spark, df, "")
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [rows[0], (3, "its own line", 30, None, "y"), rows[3]]


def test_near_dedup_decides_about_rows(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(None, a), (7, a), (7, a), (5, a + " tail"), (None, b), (None, b), (9, c), (9, prose(4, 60)), (None, None), (None, None), (3, "")]
    df = spark.createDataFrame([(i, t, 0, "g") for i, t in rows], "doc_id bigint, text string, row_number int, gone string").repartition(3)
    out = corpus_pipeline.near_dedup(spark, df, "")
    assert out.columns == df.columns
    want = [(5, a + " tail"), (None, b), (9, c), (9, prose(4, 60)), (None, None), (None, None), (3, "")]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_decontamination_decides_about_texts(spark, folder):
    dirty = prose(8, 10) + " " + prose(9000, 20)
    rows = [(None, dirty), (1, dirty), (1, prose(5, 40)), (None, prose(6, 40)), (2, None)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, text_sha256 string")
    out = corpus_pipeline.decontamination(spark, df, folder)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(rows[2:], key=repr)
