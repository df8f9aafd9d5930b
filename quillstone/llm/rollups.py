"""Token counts as delta-maintained rollups.

A ledger holds additive totals (documents, tokens) by source, language and tokenizer version as signed deltas:
an insert adds a document's count, a delete takes it back, a revision takes the old and adds the new.  Deltas of a
batch are pre-aggregated to one row per group and committed under the batch's name.  A commit is idempotent: a
name that is committed is not committed again, and readers see a batch only once a manifest names it, so a batch
that was lost half-way is simply committed anew, and a compaction that was lost half-way changes nothing.

Counts are DataFrame functions.  Edge cases: a null or empty text counts no token but one document; null source or
language is a group of its own; repeated rows each count; labels that are null or repeat are reduced to one row a
document before they act; documents of null doc_id are inserted and never deleted or revised; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, word_count

GROUP = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizer versions: name -> count of a text column.
TOKENIZERS = {
    "words/1": word_count,
    "pieces/1": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]")), F.lit(0)).cast("long"),
}


def aggregated(deltas: DataFrame, *more: str) -> DataFrame:
    """Signed deltas, one row per group; groups that cancel out keep no row."""
    sums = deltas.groupBy(*more, *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


def inserts(docs: DataFrame, tokenizer: str) -> DataFrame:
    return docs.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), TOKENIZERS[tokenizer](F.col("text")).alias("n_tokens"))


def deletes(docs: DataFrame, tokenizer: str) -> DataFrame:
    return inserts(docs, tokenizer).withColumns({c: -F.col(c) for c in ("n_docs", "n_tokens")})


def revisions(old: DataFrame, new: DataFrame, tokenizer: str) -> DataFrame:
    return deletes(old, tokenizer).unionByName(inserts(new, tokenizer))


class Ledger:
    """Committed batches under a folder that all executors share.

    Data folders count only if the newest manifest names them.  A manifest (which batches are committed, which
    folders are live) is written beside its place and renamed into it, under the next number; a writer whose number is
    taken reads the new manifest and tries again.  So a reader sees a commit or a compaction wholly or not at all,
    whenever the writer stops.  Between writers this is safe where rename refuses an existing target, as on HDFS."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._of(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self) -> tuple[int, dict]:
        known = [n for n in self._names("manifests") if re.fullmatch(r"\d{9}", n)]
        if not known:
            return 0, {"committed": [], "live": []}
        stream = self._fs.open(self._of(f"{self.path}/manifests/{known[-1]}"))
        try:
            return int(known[-1]), json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, number: int, manifest: dict) -> bool:
        """Put the manifest under its number; False if another writer has it."""
        target, beside = (self._of(f"{self.path}/manifests/{n}") for n in (f"{number:09d}", f".{uuid.uuid4().hex}"))
        stream = self._fs.create(beside)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.exists(target) and self._fs.rename(beside, target):
            return True
        self._fs.delete(beside, False)
        return False

    def _write(self, name: str, deltas: DataFrame) -> str:
        folder = f"{name}-{uuid.uuid4().hex}"  # of its own, so that no writer touches another's
        deltas.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def _read(self, live: list[str]) -> DataFrame:
        if not live:
            return self.spark.createDataFrame([], _SCHEMA)
        return aggregated(self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/data/{f}" for f in live]))

    def committed(self, batch: str) -> bool:
        return batch in self._manifest()[1]["committed"]

    def batches(self) -> list[str]:
        return sorted(self._manifest()[1]["committed"])

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add the batch unless it is committed; says whether it was added."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self.committed(batch):
            return False
        folder = self._write(batch, aggregated(deltas))
        while True:
            number, now = self._manifest()
            if batch in now["committed"]:  # another writer was faster: its deltas count
                return False
            if self._publish(number + 1, {"committed": [*now["committed"], batch], "live": [*now["live"], folder]}):
                return True

    def totals(self) -> DataFrame:
        """The rollup: sums of all committed deltas; groups without documents are gone."""
        return self._read(self._manifest()[1]["live"]).where("n_docs <> 0")

    def compact(self) -> None:
        """Fold the live folders into one; their batches stay committed."""
        folded = self._manifest()[1]["live"]
        folder = self._write("compact", self._read(folded))
        while True:
            number, now = self._manifest()
            if not set(folded) <= set(now["live"]):  # another one folded them
                return
            live = [folder, *(f for f in now["live"] if f not in folded)]
            if self._publish(number + 1, {"committed": now["committed"], "live": live}):
                return

    def vacuum(self) -> None:
        """Delete what the newest manifest does not name.  For times without readers or writers."""
        number, now = self._manifest()
        for folder in set(self._names("data")) - set(now["live"]):
            self._fs.delete(self._of(f"{self.path}/data/{folder}"), True)
        for name in self._names("manifests"):
            if name != f"{number:09d}":
                self._fs.delete(self._of(f"{self.path}/manifests/{name}"), False)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\x20\x09-\x0D]+", " ")


def op5_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those labelled low quality are deleted; those labelled toxic are revised to
    their text without punctuation; the living ones are counted anew under a second tokenizer version; and one
    batch is delivered twice.  Texts are counted in one pass; only counts are shuffled."""
    words, piece = TOKENIZERS["words/1"], TOKENIZERS["pieces/1"]
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", words(F.col("text")).alias("w"), words(_stripped(F.col("text"))).alias("w2"), piece(F.col("text")).alias("p"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = docs.join(labels.where("doc_id is not null"), "doc_id", "left")
    gone = F.coalesce(F.col("quality") == 0, F.lit(False))
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False)) & ~gone

    def delta(batch: str, tokenizer: str, n_docs: int, tokens: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(batch).alias("batch"), F.lit(tokenizer).alias("tokenizer"), F.lit(n_docs).cast("long").alias("n_docs"), tokens.alias("n_tokens")))

    each = F.array(
        delta("1-load", "words/1", 1, F.col("w"), F.lit(True)), delta("2-drop", "words/1", -1, -F.col("w"), gone),
        delta("3-revise", "words/1", 0, F.col("w2") - F.col("w"), toxic), delta("4-recount", "pieces/1", 1, F.col("p"), ~gone))
    deltas = checkpointed(aggregated(marked.select("source", "lang", F.inline(F.array_compact(each))), "batch"))
    ledger = Ledger(spark, f"{spark.sparkContext.getCheckpointDir()}/rollup-{uuid.uuid4().hex}")
    for batch in ("1-load", "2-drop", "3-revise", "2-drop", "4-recount"):
        ledger.commit(batch, deltas.where(F.col("batch") == batch).drop("batch"))
    return ledger.totals()


OP5_SQL = r"""
WITH l AS (SELECT doc_id, min(quality) = 0 AS gone, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT source, lang, coalesce(gone, false) AS gone, coalesce(toxic, false) AS toxic, coalesce(text, '') AS t FROM documents LEFT JOIN l USING (doc_id)),
c AS (SELECT source, lang, 'words/1' AS tokenizer,
        len(regexp_extract_all(CASE WHEN toxic THEN regexp_replace(t, '[^\p{L}\p{N}\x20\x09-\x0D]+', ' ', 'g') ELSE t END, '[^\x20\x09-\x0D]+')) AS n FROM d WHERE NOT gone
  UNION ALL
  SELECT source, lang, 'pieces/1', len(regexp_extract_all(t, '\p{L}+|\p{N}|[^\p{L}\p{N}\x20\x09-\x0D]')) FROM d WHERE NOT gone)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM c GROUP BY source, lang, tokenizer
"""
