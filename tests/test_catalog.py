"""Every registered query whose result SQL can express, over a small copy of the tables, against DuckDB."""

import math
import random

import duckdb
import pytest

from kugiri import catalog


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice(["the ", "tion", "é", ". ", "on", "12", "que", "\n", "a/b", "\\", "ent ", "Ñ", "日本", "カナ", "x"]) for _ in range(n))
    docs = [(i, text(rng.randint(1, 60)), rng.choice(["en", "fr"]), "s", 0) for i in range(25)] + [(90, None, "en", "s", 0), (91, "", "en", "s", 0), (92, "a", None, "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, t, "user", text(20)) for i in range(5) for t in range(3)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, "u", f"<p>{text(20)}") for i in range(5)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(i, text(12)) for i in range(6)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def plain(table):
    names = sorted(table.column_names)
    clean = lambda x: "nan" if isinstance(x, float) and math.isnan(x) else int(x) if type(x).__name__ == "Decimal" else x
    return names, sorted((tuple(map(clean, r)) for r in zip(*(table.column(n).to_pylist() for n in names))), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
    got, want = plain(catalog.QUERIES[name](spark, sf_dir).toArrow()), plain(con.sql(catalog.ORACLE[name]).to_arrow_table())
    assert got == want
