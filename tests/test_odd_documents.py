"""Documents without any line (empty or null texts) and with an empty first one."""

import duckdb
import pytest

from attestor.plans.catalogue import ORACLE_SQL, QUERIES

TEXTS = ["a line\nand more", "", None, "\nsecond", "\n", "only"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", f"src{i % 2}") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["checklist_gaps", "document_titles", "front_matter_fields", "metadata_broadcast", "parse_markdown", "rendered_markdown"])
def test_as_the_sql(name, spark, odd):
    df = QUERIES[name](spark, str(odd))
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted(want, key=repr)


def test_blocks_end_before_an_empty_first_line(spark, odd):
    rows = QUERIES["parse_blocks"](spark, str(odd)).collect()
    assert len(rows) == 3 * len(TEXTS)
    assert sorted((r.line_end, r.text) for r in rows if r.line_start == 1) == [(1, "one")] * 4 + [(2, "one\na line"), (2, "one\nonly")]
