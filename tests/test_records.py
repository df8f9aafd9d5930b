"""Record readers on literal files."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from quillstone.sources import records as R


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_json_contents(spark, tmp_path):
    codes = ['a = "x"\n', "tab\t\\ é", ""]
    (tmp_path / "c.json").write_text("[" + ", ".join(json.dumps({"id": i, "content": c, "length": len(c)}) for i, c in enumerate(codes)) + ', {"content": 3, "length": 0}, {"content":"cut')
    assert rows(R.json_contents(spark, str(tmp_path / "c.json"))) == sorted((c,) for c in codes)


def test_code_strings_and_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a": {"code_string": "x = 1\n", "msg": "ok"}, "b": {"code_string": 'y["k"]', "msg": "bad, very"}}, indent=1))
    assert rows(R.code_strings(spark, str(tmp_path / "m.json"))) == [("x = 1\n",), ('y["k"]',)]
    assert rows(R.code_map(spark, str(tmp_path / "m.json"))) == [("a", "x = 1\n", "ok"), ("b", 'y["k"]', "bad, very")]


def test_manifest(spark, tmp_path):
    (tmp_path / "src" / "d").mkdir(parents=True)
    for n in ("a.py", "d/b.py", "d/c.py"):
        (tmp_path / "src" / n).write_text(f"# {n}")
    (tmp_path / "list.txt").write_text("a.py\nd/c.py\nmissing.py\n\na.py\n")
    got = [tuple(r) for r in R.manifest_texts(spark, str(tmp_path / "list.txt"), str(tmp_path / "src")).collect()]
    assert sorted(got) == [("a.py", "# a.py"), ("d/c.py", "# d/c.py")]
    assert got == [tuple(r) for r in R.manifest_texts(spark, str(tmp_path / "list.txt"), str(tmp_path / "src")).collect()]


def test_frozen_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_text("one\n\nthree\n")
    assert rows(R.frozen_lines(spark, str(tmp_path / "f.txt"))) == [(0, "one"), (1, ""), (2, "three")]


def test_balanced_records(spark):
    b64 = lambda s: base64.b64encode(s.encode()).decode()
    recs = [("a b", "a b c", "A", "B é"), ("a b", "a b c", "A", "B é"), ("x", "x y z", "X", "Y"), ("known", "known k", "K", "L"), ("q r", "q r s", "Q", "R"), ("t u", "t u v", "T", "U")]
    flat = [v for b, f, s, g in recs for v in (b, f, b64(s), b64(g))] + ["tail", "cut"]
    lines = spark.createDataFrame(list(enumerate(flat)), "ordinal long, value string")
    got = R.balanced_records(lines, spark.createDataFrame([("known",)], "broken string"), most=2).collect()
    assert len(got) == 3 and {(r["bucket"], r["dist"]) for r in got} == {(0, 1), (0, 2)}
    assert {(r["broken"], r["broken_src"], r["fixed_src"]) for r in got} <= {(b, s, g) for b, _, s, g in recs} - {("known", "K", "L")}


def test_rewritten_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"repo":"r","code":"a+b"}\n{"repo":"s","code":"c"}\n')
    out = R.rewritten_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), "repo string, code string", {"swap": lambda c: F.translate(c, "+", "-"), "upper": F.upper})
    assert [rows(spark.read.schema("repo string, code string").json(p)) for p in out] == [[("r", "a-b"), ("s", "c")], [("r", "A+B"), ("s", "C")]]
    with pytest.raises(ValueError):
        R.rewritten_jsonl(spark, "x.csv", "y", "a string", {})


def test_hash_index(spark):
    index = R.hash_index(spark.createDataFrame([("u",), ("v",), ("u",)], "uri string"))
    wanted = spark.createDataFrame([("u",), ("w",)], "w string").select(F.md5("w").alias("hash"), "w")
    assert rows(R.by_hash(wanted, index).select("w", "uri")) == [("u", "u"), ("w", R.MISSING)]


def test_repositories(spark):
    schema = "name string, owner_type string, forks int, size int, stars int, issues int, text string"
    listing = [("a", "Organization", 100, 1000, 5, 1, "x"), ("b", "User", 500, 5000, 9, 9, "x"), ("c", "Organization", 99, 5000, 9, 9, "x"), ("d", "Organization", 200, 10_001, 9, 9, "x"),
               ("e", "Organization", 200, 2000, 8, 7, "漢"), ("f", "Organization", 200, 2000, 8, 7, "y"), ("g", "Organization", 200, 2000, 1, 99, "y")]
    df = spark.createDataFrame(listing, schema)
    assert [r["name"] for r in R.sample_repositories(df).collect()] == ["g", "f", "a"]
    assert [r["name"] for r in R.sample_repositories(df, most=4).collect()] == ["f", "a"]
    own = spark.createDataFrame([("p",), ("q",), (None,)], "name string")
    assert rows(R.without_copies(own, spark.createDataFrame([("q",), ("q",)], "name string"), "name")) == [("p",)]


def test_pages_and_padding(spark, tmp_path):
    pages = spark.createDataFrame([("Kotlin" + "." * 10 + "fork",), ("." * 10 + "Kotlin",), ("." * 10 + "Kotlin fork",), (None,)], "page string")
    assert [r[0] for r in pages.select(R.page_admits(F.col("page"), "Kotlin", ["fork"], skip=8)).collect()] == [False, True, False, False]
    R.write_padded(spark.createDataFrame([("a", 3), (None, 12)], "t string, n int"), str(tmp_path / "csv"), {"t": 4, "n": 3})
    assert sorted(p.read_text() for p in (tmp_path / "csv").glob("*.csv")) == ["t,n\na   ,3  \n    ,12 \n"]


def test_char_dataset(spark):
    words = spark.createDataFrame([(f"w{i}",) for i in range(200)] + [(" w1 ",), ("",)], "word string")
    chars, train, test = R.char_dataset(words)
    assert rows(chars)[0] == ("0", 1) and chars.count() == 11
    assert train.count() + test.count() == 200 and 5 < test.count() < 50 and train.intersect(test).count() == 0
