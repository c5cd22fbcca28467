"""Queries over texts that are empty, blank, full of line ends or look like what the query looks for, against their SQL."""

import duckdb
import pytest

from scholia.plans import catalog

TEXTS = [
    None, "", " ", "\n", "\n\n", "\t", " \n \t\n", "abc", " abc ", "　x  y　", "\vabc\v", " abc\x85", "end\n \n", "a\r\nb\r\n", "a\rb\vc\fd\x1ce\x1df\x1eg\x85h i j", "a\nb\nc\r",
    "# head\ntext", "x\n# head\ny\n#", "x\n  ## indented ##\ny", "x\r# head\n\t# tab\n\f# feed\n　# wide", "#\n##\n####### seven", "一、标题\n（二）文", "x\n\n\n\ny\n\n",
    "abcd. abcd. abcd. x", "abcd\t. abcd. abcd\t\n\nabcd", "foo bar\n \nfoo bar\n\t\nfoo bar", "\n\nfoo bar\n\nfoo bar\n\n\nfoo bar\n", "abc. abc. abc", "<b>x", "[x]",
]


@pytest.mark.parametrize("name", ["split_sections", "text_markdown", "text_repeated_lines"])
def test_odd_texts_as_in_sql(spark, tmp_path, name):
    rows = [(i, t, "en", "src1") for i, t in enumerate(TEXTS)] + [(100, "abc", None, "src1"), (101, "abc", "en", None), (102, None, None, None)]
    rows += [(110 + i, "abc", n, n) for i, n in enumerate(["", " ", "s ", " s", "s #", "#", "## s"])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    other = duckdb.connect()
    other.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = other.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
