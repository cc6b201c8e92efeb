"""Every registered query against its SQL; those without SQL give rows with a stable schema."""

import compare
import pytest

from __spark_entry__ import ORACLES, QUERIES, entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare.difference(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert 0 < entry(spark).count() <= 8


def test_text_blocks_of_texts_with_headings(spark, tmp_path):
    texts = ["# A\n\nfirst\n\nsecond one", "# A\nbody of it\n\nrest", "before\n## B\nafter", " \n\n###### C\n\n- a\n- b\n\nlast", "####### seven\n\n#none\n\n#", "a\n\n\n# D\n\n\n\nb", "Short title\n\n## E", "## F\n\n# G", "", None, "# H ##\n- a\n- b\nc", "#\u0020\nx", "# #", "- a\nb\nc", "1. one\n\n2. two"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = compare.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert QUERIES["text_blocks"](spark, str(tmp_path)).count() == 12  # a heading without a title is no block
    assert compare.difference(spark, con, "text_blocks", QUERIES["text_blocks"], ORACLES["text_blocks"], str(tmp_path)) is None


def differs(spark, path, name, **tables):
    """difference of a query on tables of its own: (rows, schema) by name."""
    con = compare.duckdb.connect()
    for t, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return compare.difference(spark, con, name, QUERIES[name], ORACLES[name], str(path))


DOCS, VECTORS = "doc_id long, text string, lang string, source string", ([(0, [1.0] + [0.0] * 63)], "vec_id long, embedding array<float>")


def test_source_fulltext_where_another_is_named(spark, tmp_path):
    """A title holds the whole question, and another document has most hits: SQL takes the dominant one."""
    texts = ["the with that " * 3, "that the x with " * 9, "with that the " * 500]
    assert differs(spark, tmp_path, "source_fulltext", documents=([(k + 1, t, "en", "src1") for k, t in enumerate(texts)], DOCS), embeddings=VECTORS) is None


def test_text_helpers_of_texts_that_begin_with_a_digit(spark, tmp_path):
    texts = ["2024 sales", "94 182.225", " 7", "_9 lives_", "one 2", "نام", "", None]
    assert differs(spark, tmp_path, "text_helpers", documents=([(k, t, "en", "src1") for k, t in enumerate(texts)], DOCS)) is None


def test_content_dedupe_counts_places(spark, tmp_path):
    """Places run from 0 over all chunks, those of removed copies too."""
    texts = ["b c d " * 200, "a", "b", "a", "x y " * 500, "b", "A", None, " "]
    docs = [(k * 7, t, "en", "src1") for k, t in enumerate(texts)]
    assert differs(spark, tmp_path, "content_dedupe", documents=(docs, DOCS), embeddings=VECTORS) is None
    places = [r["position"] for r in QUERIES["content_dedupe"](spark, str(tmp_path)).collect()]
    assert min(places) == 0 and max(places) < 12


def test_runs_and_chains_within_a_row(spark, tmp_path):
    from quillspark.operators import structure

    texts = ["a\n|x|y|\n|--|--|\n|1|2|\nb", "|a|\n|b|", " |a|\n\t| - |\n", "", None, "\n\n", "# H\nshort\nlong enough to be a paragraph, it ends with a stop.\n# T\n- x\n- y", "one.\ntwo.\n#\n## L", "|a b|\n|--|\n" + "|word word word|\n" * 400]
    tables = {"documents": ([(k, t, "en", "src1") for k, t in enumerate(texts)], DOCS)}
    for name in ("table_blocks", "section_chain"):
        assert differs(spark, tmp_path / name, name, **tables) is None
        assert "Exchange" not in QUERIES[name](spark, str(tmp_path / name))._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    chained = structure.section_chain(structure.blocks(df), "doc_id")
    assert sorted(map(str, structure.chained_blocks(df).select(*chained.columns).collect())) == sorted(map(str, chained.collect()))
