"""Scans and record readers of text corpora."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import padded_chars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, root: str, extension: str | tuple[str, ...] | None = None, archives: bool = False) -> DataFrame:
    """(uri, content) of all files below root, of one extension, of some or of any; with archives also members of zip and tar files."""
    if isinstance(extension, tuple):
        return files(spark, root, None, archives).where(F.substring_index("uri", ".", -1).isin(*extension))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extension and not archives:
        reader = reader.option("pathGlobFilter", f"*.{extension}")
    found = reader.load(root).select(F.col("path").alias("uri"), "content")
    if archives:
        found = found.mapInArrow(_members, "uri string, content binary")
    return found.where(F.substring_index("uri", ".", -1) == extension) if extension else found


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, content in zip(batch.column("uri").to_pylist(), batch.column("content").to_pylist()):
            rows = [(uri, content)]
            try:
                if uri.endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(f"{uri}!/{n}", z.read(n)) for n in z.namelist() if not n.endswith("/")]
                elif uri.endswith((".tgz", ".tar.gz", ".tar")):
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        rows = [(f"{uri}!/{m.name}", t.extractfile(m).read()) for m in t if m.isfile()]
            except (zipfile.BadZipFile, tarfile.TarError, OSError):
                rows = []  # an unreadable archive has no members
            if rows:
                yield pa.RecordBatch.from_pydict({"uri": [r[0] for r in rows], "content": pa.array([r[1] for r in rows], pa.binary())})


def shuffled(df: DataFrame, key: Column, seed: int = 1) -> DataFrame:
    """A deterministic permutation: order by a hash of the key."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), key)


def lines(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep..., line_no from 0, line)."""
    return df.select(*keep, F.posexplode(F.split(text, "\r\n|\n|\r", -1)).alias("line_no", "line"))


def fragments(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Trimmed lines that hold a letter or digit, with their 0-based number."""
    found = lines(df, text, *keep).where(F.col("line").rlike(r"[\p{L}\p{Nd}]"))
    return found.withColumn("line", F.trim("line"))


def with_tokens(df: DataFrame, tokens: Column, *keep: str) -> DataFrame:
    """(keep..., w): a token array behind a generator, so that functions of it don't tokenise again for each use."""
    return df.select(*keep, F.explode(F.array(tokens)).alias("w"))


def substring_range(text: Column, start: int = 0, end: int = -1) -> Column:
    """Characters from start to end (exclusive; -1: the end)."""
    return F.substr(text, F.lit(start + 1), F.lit(end - start)) if end >= 0 else F.substr(text, F.lit(start + 1))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated records: (first, second, rest array)."""
    raw = spark.read.option("lineSep", "\n\n").text(path)
    parts = F.split(F.btrim("value", F.lit("\n")), "\n")
    return raw.where(F.length(F.trim("value")) > 0).select(
        F.get(parts, F.lit(0)).alias("first"), F.get(parts, F.lit(1)).alias("second"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("rest"))


def tumbling(df: DataFrame, ordinal: str, value: str, n: int, names: list[str], keep_tail: bool = False) -> DataFrame:
    """Records of n consecutive rows: row i of a record becomes column names[i]; an incomplete tail goes unless kept."""
    picked = [F.max(F.when(F.col(ordinal) % n == i, F.col(value))).alias(c) for i, c in enumerate(names)]
    out = df.groupBy(F.floor(F.col(ordinal) / n).alias("record")).agg(*picked, F.count(F.lit(1)).alias("n"))
    return (out if keep_tail else out.where(F.col("n") == n)).drop("n")


def production_counts(spark: SparkSession, path: str) -> DataFrame:
    """``A B C ::: n`` lines -> (symbols array, count)."""
    raw = spark.read.text(path).where(F.contains("value", F.lit(" ::: ")))
    return raw.select(F.split(F.substring_index("value", " ::: ", 1), " ").alias("symbols"), F.trim(F.substring_index("value", " ::: ", -1)).cast("long").alias("n"))


def edit_contexts(spark: SparkSession, path: str, diversity: float = 1.0, drop_unknown: bool = False) -> DataFrame:
    """Padded CSV of edit contexts -> trimmed columns, freq = max(1, int(freq ^ diversity))."""
    names = ["type", "left", "old_mid", "right", "new_mid", "freq"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names))
    out = raw.select(*[F.trim(n).alias(n) for n in names[:-1]], F.greatest(F.lit(1), F.pow(F.trim("freq").cast("double"), F.lit(diversity)).cast("long")).alias("freq"))
    return out.where("old_mid <> 'UNKNOWN_CHAR' and new_mid <> 'UNKNOWN_CHAR'") if drop_unknown else out


def training_log(df: DataFrame, line: str = "line", order: str = "line_no", by: str | None = None) -> DataFrame:
    """Log lines -> (step, loss, mrr, val); a validation line takes the step before it.  ``by`` names the log: one task a log."""
    num = r"([0-9.]+)"
    step = F.regexp_extract(line, r"step\s+(\d+)", 1)
    got = df.select(*([by] if by else []), order, *[F.nullif(F.regexp_extract(line, rf"{k}\s+{num}", 1), F.lit("")).cast("double").alias(a) for k, a in (("loss", "loss"), ("mrr", "mrr"), (r"val@1", "val"))],
                    F.nullif(step, F.lit("")).cast("long").alias("own"))
    return got.withColumn("step", F.last("own", ignorenulls=True).over(Window.partitionBy(F.col(by) if by else F.lit(0)).orderBy(order))).drop("own")


def small_repairs(records: DataFrame, tokens: tuple[int, int], most: Column, distance: Column) -> DataFrame:
    """2-line records (``first`` broken, ``second`` fixed) whose broken side has a fitting number of tokens and whose distance is at most that."""
    size = F.size(F.split("first", " "))
    return records.where(size.between(*tokens) & (distance <= most))


def ngram_model(spark: SparkSession, path: str) -> DataFrame:
    """(ngram, n) of a CSV whose last column is the count and whose other columns are the tokens."""
    parts = F.split("value", ",")
    raw = spark.read.text(path).where(F.size(parts) > 1)
    return raw.select(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda t: F.trim(t)).alias("ngram"), F.trim(F.element_at(parts, -1)).cast("long").alias("n")).where("n is not null")


def merged_models(*models: DataFrame) -> DataFrame:
    """(ngram, n): counts of all models added."""
    every = models[0]
    for m in models[1:]:
        every = every.unionByName(m)
    return every.groupBy("ngram").agg(F.sum("n").alias("n"))


def write_split(df: DataFrame, key: str, path: str, every: int = 10) -> None:
    """``path/train`` and ``path/valid``: one row in ``every``, by hash of the key, validates."""
    held = F.pmod(F.xxhash64(key), F.lit(every)) == 0
    df.where(~held).write.mode("overwrite").parquet(f"{path}/train")
    df.where(held).write.mode("overwrite").parquet(f"{path}/valid")


def training_batches(blocks: DataFrame, negatives: int, size: int) -> DataFrame:
    """Blocks (first = query, second = truth, rest = candidates) -> (batch, query, positive, negatives): the first candidates that
    aren't the truth, blocks without enough of them left out; batches in hash order of the query."""
    wrong = F.filter("rest", lambda c: c != F.col("second"))
    rows = blocks.select(F.col("first").alias("query"), F.col("second").alias("positive"), F.slice(wrong, 1, negatives).alias("negatives")).where(F.size("negatives") == negatives)
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.md5("query"), "query", "positive")) - 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(64)))  # batches are cut inside 64 parts, not in one task
    return rows.withColumn("batch", F.concat_ws("-", "part", F.floor(nth / size))).drop("part")


def query_with_document(query: Column, document: Column, size: int, separator: str = "|") -> Column:
    """Padded character codes of the query, a separator and the document."""
    return padded_chars(F.concat(query, F.lit(separator), document), size)


def texts(found: DataFrame, extensions: tuple[str, ...] = ("java", "kt", "py", "txt", "md")) -> DataFrame:
    """``files`` -> (uri, text): decoded contents, null for other extensions, whether a file of its own or an archive's member."""
    return found.select("uri", F.when(F.substring_index("uri", ".", -1).isin(*extensions), F.decode("content", "UTF-8")).alias("text"))


def indexed_lines(found: DataFrame, extensions: tuple[str, ...] = ("java", "kt", "py", "txt", "md")) -> DataFrame:
    """``files`` -> (uri, line_no, line): the fragments of all texts, what an index is fed with."""
    return fragments(texts(found, extensions).where("text is not null"), "text", "uri")
