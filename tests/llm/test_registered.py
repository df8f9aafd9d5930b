"""The registered queries with their SQL, on the smallest tables and on tables of odd rows."""

import duckdb
import pytest

from quillstone.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels conversations".split()



def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def compare(spark, name, sf):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'' if sf == SF else '/*.parquet'}'")
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want
    return len(want)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty, blank, repeated and long rows, null ids and sources, extra columns."""
    path = str(tmp_path_factory.mktemp("odd"))
    long = "a long line of words 12 with a field\n" * 3000
    texts = [None, "", " \n\t", "one", "Les.", "Les.\n\nLes.", "lead one two p q r s", "lead one two p q r t\r\nLes.", "1 2 3\n4 5 6\n1 2 3", long, long + "tail here now", "x\ry\rz", "a b c d e f g h i j k l"]
    docs = [(i, t, ["a", "b", None][i % 3], "en") for i, t in enumerate(texts)] + [(None, t, "a", None) for t in texts[:6]] + [(3, texts[3], "a", "en")] * 3 + [(20, "a b c d e f g h z j k l", "c", "fr"), (21, "a b c d e f g h q j k l", "c", "fr")]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, lang string, lines string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, None, None), (3, 1, 1), (3, 0, 0), (None, 0, 1), (99, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    talk = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (2, 0, "assistant", None), (2, 1, "user", ""), (3, 0, "user", "no answer"), (5, 0, None, None), (5, 1, "assistant", "a5"), (5, 1, "assistant", "a5"), (None, 0, "assistant", "lost")]
    talk += [(8, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(400)]
    spark.createDataFrame([(*t, "k") for t in talk], "conv_id long, turn long, role string, text string, pair_id string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, [1.0] * 4, 0), (50, [1.0, 1.0, 1.0, 0.9], 0), (3, None, None), (100, [0.0] * 4, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<p>text, here.</p>"), (None, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, name, SF) > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql_on_odd_rows(spark, odd, name):
    assert compare(spark, name, odd) > 0


@pytest.mark.parametrize("name, columns, rows", [
    ("op2_simhash", {"doc_id", "fingerprint", "component_id"}, 24), ("op3_ann", {"query_id", "rank", "vec_id", "score"}, 1), ("op4_bpe", {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, 24),
    ("op6_toxicity", {"doc_id", "held_out", "score", "predicted"}, 24), ("op7_html", {"page_id", "url", "text", "n_chars"}, 2), ("op9_caps", {"vec_id", "n_links", "component_id", "kept"}, 4)])
def test_the_other_queries_take_odd_rows(spark, odd, name, columns, rows):
    got = queries.QUERIES[name](spark, odd)
    assert columns <= set(got.columns) and got.count() == rows
