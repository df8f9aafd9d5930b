"""Readers of record formats: JSON contents, code maps, manifests, base64 records, repository lists; and rewritten copies of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import without_cjk
from .corpus import shuffled

MISSING = "MISSING"


def json_contents(spark: SparkSession, path: str) -> DataFrame:
    """(content): the decoded content strings of one-line JSON records, however they nest; text between records is ignored.

    Lines are cut at the records' openings by the reader, so one huge line is many rows."""
    raw = spark.read.option("lineSep", '"content":').text(path)
    quoted = F.regexp_extract("value", r'^\s*("(?:[^"\\]|\\.)*+")\s*,\s*"length"', 1)
    return raw.select(F.from_json(F.concat(F.lit('{"c":'), quoted, F.lit("}")), "c string")["c"].alias("content")).where("content is not null")


def code_strings(spark: SparkSession, path: str) -> DataFrame:
    """(code): the values of ``"code_string": "..."`` lines of a pretty-printed JSON map; lines that don't decode are skipped."""
    raw = spark.read.text(path).where(F.trim("value").startswith('"code_string":'))
    body = F.regexp_replace(F.trim("value"), ",$", "")
    return raw.select(F.get_json_object(F.concat(F.lit("{"), body, F.lit("}")), "$.code_string").alias("code")).where("code is not null")


def code_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, code_string, msg) of a JSON map of records."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<code_string:string,msg:string>>").alias("m"))
    return raw.select(F.explode("m").alias("id", "r")).select("id", "r.code_string", "r.msg")


def manifest_texts(spark: SparkSession, manifest: str, root: str, seed: int = 1) -> DataFrame:
    """(path, text) of the files that a manifest lists, one relative path a line, in the order of a seeded shuffle."""
    listed = spark.read.text(manifest).select(F.trim("value").alias("path")).where("path <> ''").distinct()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = found.select(F.regexp_replace(F.col("path"), "^file:/+", "/").alias("at"), F.decode("content", "UTF-8").alias("text"))
    base = root.rstrip("/") + "/"
    return shuffled(own.where(F.startswith("at", F.lit(base))).select(F.substr("at", F.lit(len(base) + 1)).alias("path"), "text").join(listed, "path", "left_semi"), F.col("path"), seed)


def frozen_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file that was fetched once; numbers rise in file order."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line_no", "line"))
    return raw


def balanced_records(lines: DataFrame, training: DataFrame, most: int = 300, lengths: int = 10, distance: Column | None = None) -> DataFrame:
    """4-line records (tokens broken, tokens fixed, two base64 sources) -> (broken, fixed, broken_src, fixed_src, bucket, dist).

    ``lines(ordinal, value)``; an incomplete last record goes.  At most ``most`` distinct pairs of each (length bucket,
    distance) stay, smallest hash first, and none whose broken side is in ``training(broken)``."""
    record = F.floor(F.col("ordinal") / 4)
    part = lambda i: F.max(F.when(F.col("ordinal") % 4 == i, F.col("value")))
    got = lines.groupBy(record.alias("record")).agg(
        part(0).alias("broken"), part(1).alias("fixed"), part(2).alias("b"), part(3).alias("f"), F.count(F.lit(1)).alias("n")).where("n = 4")
    source = lambda c: F.decode(F.unbase64(c), "UTF-8")
    got = got.select("broken", "fixed", source("b").alias("broken_src"), source("f").alias("fixed_src")).distinct()
    size = F.size(F.split("broken", " "))
    dist = F.abs(size - F.size(F.split("fixed", " "))) if distance is None else distance
    got = got.withColumns({"bucket": (F.floor(size / lengths) * lengths).cast("long"), "dist": dist.cast("long")}).join(training, "broken", "left_anti")
    order = Window.partitionBy("bucket", "dist").orderBy(F.md5(F.concat_ws("\n", "broken", "fixed")), "broken", "fixed", "broken_src", "fixed_src")
    return got.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth")


def rewritten_jsonl(spark: SparkSession, source: str, target: str, schema: str, rewrites: dict[str, Callable[[Column], Column]], field: str = "code") -> list[str]:
    """For each rewrite a copy of the JSON lines with the field rewritten, in ``<target>/<name>``; the folders written."""
    if not source.endswith((".json", ".jsonl")):
        raise ValueError(f"not JSON lines: {source}")
    rows, out = spark.read.schema(schema).json(source), []
    for name, rewrite in rewrites.items():
        out.append(f"{target}/{name}")
        rows.withColumn(field, rewrite(F.col(field))).write.mode("overwrite").json(out[-1])
    return out


def hash_index(uris: DataFrame, uri: str = "uri") -> DataFrame:
    """(hash, uri): the smallest URI of each hash."""
    return uris.groupBy(F.md5(uri).alias("hash")).agg(F.min(uri).alias("uri"))


def by_hash(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """``wanted(hash, ...)`` with the URI of each hash, MISSING where there is none."""
    return wanted.join(index, "hash", "left").withColumn("uri", F.coalesce("uri", F.lit(MISSING)))


def sample_repositories(found: DataFrame, least_forks: int = 100, sizes: tuple[int, int] = (1000, 10_000), most: int = 2000, kind: str = "Organization") -> DataFrame:
    """Of a listing (name, owner_type, forks, size, stars, issues, text): the most starred ones with enough forks and a fitting
    size, of these the organisations' without CJK text, by falling number of open issues."""
    top = found.where((F.col("forks") >= least_forks) & F.col("size").between(*sizes)).orderBy(F.desc("stars"), "name").limit(most)
    return top.where((F.col("owner_type") == kind) & without_cjk(F.col("text"))).orderBy(F.desc("issues"), "name")


def without_copies(repositories: DataFrame, elsewhere: DataFrame, key: str) -> DataFrame:
    """Repositories that another host doesn't hold; a null key can't be looked up and counts as copied."""
    return repositories.where(F.col(key).isNotNull()).join(elsewhere.select(key).distinct(), key, "left_anti")


def page_admits(page: Column, badge: str, excluded: list[str], skip: int = 3500) -> Column:
    """After the page's head (``skip`` characters) it names the badge and none of the excluded strings."""
    body = F.substr(page, F.lit(skip + 1))
    out = F.contains(body, F.lit(badge))
    for e in excluded:
        out = out & ~F.contains(body, F.lit(e))
    return F.coalesce(out, F.lit(False))


def write_padded(table: DataFrame, path: str, widths: dict[str, int]) -> None:
    """A small frequency table as one CSV file with columns padded to their widths."""
    table.coalesce(1).select(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ").alias(c) for c, w in widths.items()]).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def char_dataset(words: DataFrame, seed: int = 1, tenth: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Word list -> (characters numbered from 1, training words, test words); one word in ``tenth``, by hash, tests."""
    w = words.select(F.trim("word").alias("word")).where("word <> ''").distinct()
    chars = w.select(F.explode(F.split("word", "")).alias("char")).where("char <> ''").distinct()
    chars = chars.withColumn("id", F.row_number().over(Window.orderBy("char")))  # the alphabet: small
    test = F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(tenth)) == 0
    return chars, w.where(~test), w.where(test)
