"""Operators without SQL: small fixtures with known results."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import sequences, text
from quillstone.operators import edits, relalg, stats, vecindex
from quillstone.sources import corpus
from quillstone.streaming import online


def test_alignment_rebuilds_the_target():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (list(rng.choice(list("abcd"), rng.integers(0, 8))) for _ in range(2))
        out, shift = list(a), 0
        steps = sequences.alignment(a, b)
        for kind, pos, _, new in steps:
            at = pos + shift
            if kind == "SUB":
                out[at] = new
            elif kind == "DEL":
                del out[at]
                shift -= 1
            else:
                out.insert(at, new)
                shift += 1
        assert out == b
    assert len(sequences.alignment(list("kitten"), list("sitting"))) == 3 and sequences.lcs_length("abcbdab", "bdcaba") == 4


def test_context_edits(spark):
    pairs = spark.createDataFrame([(["a", "b"], ["a", "c", "b"]), (["x"], []), (["x", "y"], ["z", "y"])], "broken array<string>, fixed array<string>")
    got = {tuple(r) for r in edits.context_edits(pairs).collect()}
    assert got == {("INS", "a", "", "b", "c"), ("DEL", "BOS", "x", "EOS", ""), ("SUB", "BOS", "x", "y", "z")}
    table = edits.edit_counts(pairs).where("kind = 'SUB'")
    assert edits.relevant_edits(spark.createDataFrame([(1, ["x", "y", "q"])], "id int, w array<string>"), table).count() == 1


def test_candidates(spark):
    broken = spark.createDataFrame([(1, ["a", "b"])], "id int, w array<string>")
    got = [(r["kind"], r["pos"], tuple(r["candidate"])) for r in edits.candidates(broken, spark.createDataFrame([("b",)], "new string")).collect()]
    assert sorted(got) == [("DEL", 0, ("b",)), ("DEL", 1, ("a",)), ("INS", 0, ("b", "a", "b")), ("INS", 1, ("a", "b", "b")), ("INS", 2, ("a", "b", "b")), ("SUB", 0, ("b", "b"))]


def test_joins(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (3, "c"), (1, None)], "k int, v string")
    assert {(r["k"], tuple(r["matches"])) for r in relalg.nest_join(left, right, "k", "v").collect()} == {(1, ("a", "b")), (2, ()), (None, ())}
    with pytest.raises(Exception, match="no match"):
        relalg.total_lookup(left, right, "k", "v").collect()
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")
    assert relalg.closure(edges).count() == 9


def test_text_functions(spark):
    one = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one("f(a[1]{x})", text.bracket_balance) == 0 and one("((", text.bracket_balance) == 2
    assert one("((x))", lambda c: text.brackets_and_depth(c)["depth"]) == 1
    assert one("a if b else c ? d : e", text.approx_cyclomatic) == 4
    assert one("say hello there", lambda c: text.preview(c, "hello", 3)) == "ay hello th"
    assert one("fooBar == fooBar", lambda c: text.normal_form_distance(c, F.lit("abcXyz == abcXyz"))) >= 0
    assert one("x", lambda c: text.bin10(F.lit(9))) == 10 and one("x", lambda c: text.bucket10(F.lit(9))) == 0
    assert one("def f(:", sequences.python_error) == "SyntaxError" and one("x = 1", sequences.python_error) is None
    assert one("ab", lambda c: F.size(text.padded_chars(c, 5))) == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a.kt").write_text("fun x\n\n!!\n y")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("b.kt", "fun z")
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    found = corpus.files(spark, str(tmp_path), "kt", archives=True)
    assert found.count() == 2
    docs = found.select("uri", F.decode("content", "UTF-8").alias("text"))
    assert {(r["line_no"], r["line"]) for r in corpus.fragments(docs, "text", "uri").collect()} == {(0, "fun x"), (3, "y"), (0, "fun z")}
    (tmp_path / "p.txt").write_text("A B C ::: 3\nnoise\n")
    assert corpus.production_counts(spark, str(tmp_path / "p.txt")).collect()[0]["n"] == 3
    (tmp_path / "q.txt").write_text("q\nt\nx\ny\n\nq2\nt2\n")
    assert [(r["first"], r["rest"]) for r in corpus.blocks(spark, str(tmp_path / "q.txt")).collect()] == [("q", ["x", "y"]), ("q2", [])]


def test_knn_and_graph(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(30)], "vec_id long, embedding array<double>")
    got = vecindex.knn(rows, rows.where("vec_id = 10"), 3, block=7).orderBy("rank").collect()
    assert [(r["vec_id"], r["dist"]) for r in got] == [(9, 1.0), (11, 1.0), (8, 2.0)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long")
    assert {(r["node"], r["level"]) for r in vecindex.breadth_first(edges, 1, 2).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_ranking_metrics(spark):
    r = stats.ranking_metrics(spark.createDataFrame([(0,), (4,), (-1,)], "rank0 int"), "rank0").first()
    assert (r["n"], r["mrr"], r["p_at_1"], r["p_at_5"]) == (3, 0.4, 0.333333, 0.666667)


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(30)], "id long, label string").write.parquet(src)
    stream = spark.readStream.schema("id long, label string").parquet(src)
    online.rebalance_online(stream, "label", "id", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["label"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("label").count().collect()} == {"a": 10, "b": 10}


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_running_totals_do_not_depend_on_blocks(spark, width):
    rows = [(g, i, v) for i, (g, v) in enumerate([("a", 1), ("b", 0), ("a", 0), (None, 1), ("a", 1), ("b", 1), (None, 1), ("a", None)])]
    df = spark.createDataFrame(rows, "g string, i long, v int")
    got = {r.i: (r.hits, r.total) for r in stats.running_hits(df, "g", "i", F.coalesce(F.col("v"), F.lit(0)), width).collect()}
    seen = {}
    for g, i, v in rows:
        h, t = seen.get(g, (0, 0))
        seen[g] = (h + (v or 0), t + 1)
        assert got[i] == seen[g]


def test_lcs_distance_equals_brute_force(spark):
    from itertools import combinations

    words = ["", "a", "abcb", "bdcab", "cab", "abcbdab"]
    subs = {w: {c for n in range(len(w) + 1) for c in combinations(w, n)} for w in words}
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs + [(None, "a")], "a string, b string").select(sequences.lcs_distance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got[:-1]] == pytest.approx([1 - max(map(len, subs[a] & subs[b])) / max(len(a), len(b), 1) for a, b in pairs])
    assert got[-1][0] is None


@pytest.mark.parametrize("strings, want", [(["xabcy", "zabcw", "abc"], "abc"), (["ab", "cd"], ""), (["same"], "same"), ([], ""), (["a", None], "")])
def test_common_substring(spark, strings, want):
    df = spark.createDataFrame([(strings,)], "s array<string>")
    assert df.select(sequences.common_substring(F.col("s"))).first()[0] == want


def test_whole_neighbour_graph_matches_brute_force(spark):
    import numpy as np

    from quillstone.plans import evaluation, search

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    edges = set()
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((ids, d)) if j != i][:5]
        edges |= {(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in near}
    assert {(r["u"], r["v"]) for r in search.knn_graph_edges(spark, sf).collect()} == edges
    level, front = {0: 0}, {0}
    for step in (1, 2, 3):
        front = {b if a in front else a for a, b in edges if (a in front) != (b in front)} - set(level)
        level |= dict.fromkeys(front, step)
    assert {r["node"]: r["level"] for r in evaluation.knn_bfs(spark, sf).collect()} == level
