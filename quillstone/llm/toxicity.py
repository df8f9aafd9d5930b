"""Toxicity by multiple-instance learning with noisy-or.

A document is a bag of sentences.  Each sentence has a logistic score over hashed word and word-prefix features;
the document's probability is the noisy-or of its sentences, 1 - prod(1 - p).  Only document labels train it
(full-batch proximal Adam over a bounded, documented sample: ``max_per_class`` distinct labelled texts of each class,
smallest hash first).  Training, like scoring, covers every sentence of every whole text: texts lie in blocks of whole
sentences in the shared folder, and the gradient is summed on the driver if they are small there, else by the executors.
The same sentence scores then say where a document offends.

Inputs of a score are the text's words alone.  Edge cases: a null, empty or blank text has no sentence and scores
0; labels that are null or conflict (one doc_id with both) train nothing; without rows of both classes the model
is empty and scores are 0; repeated rows get equal scores; rows of null doc_id are scored and count as held out = false.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, strings, table, tidy

#: Bound of the training sample: labelled rows of each class that may train.
MAX_PER_CLASS = 2000
#: Weight of label 1 in the loss.
POSITIVE_SHARE = 0.3
SPACE = 1 << 18
MIN_DOCS = 3
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")
_WORD_OR_END = re.compile(r"\w+|\n")
#: Size of a training block, in features and sentences: a longer text goes on in a next block, whole sentences in each.
MAX_FEATURES = 20_000
#: Bound of what the driver trains on by itself, in features that can get a weight and sentences.
LOCAL_FEATURES = 8_000_000
#: Tasks that sum the gradient beyond that; each sends the driver one vector of SPACE numbers a step.
TASKS = 32
#: Features and sentences that are worked at a time.
BATCH = 1_000_000


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its prefixes of 4 and 5 characters."""
    out = [word] + [f"{word[:k]}-" for k in (4, 5) if len(word) > k]
    return [zlib.crc32(x.encode("utf-8", "replace")) % SPACE for x in out]


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


@dataclass(frozen=True)
class Model:
    """Weights of the hashed features and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def scorer(self, memo_size: int = 200_000, chars: int = 250_000):
        """texts -> (logits of all sentences, number of sentences by text).

        Texts are worked on some ``chars`` at a time and word scores are memoised within memo_size words, so memory is
        bounded by the longest text."""
        known = _Words(self.weights)

        def run(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
            logits, counts, lines, size = [np.empty(0)], [], [], 0

            def flush() -> None:
                words = _WORD_OR_END.findall("".join(lines).lower())
                if len(known) > memo_size:
                    known.forget()
                word = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                sentence, says = np.cumsum(word == 0), word > 1
                once = np.unique(sentence[says] * len(known.value) + word[says])  # a word counts once a sentence
                logits.append(self.bias + np.bincount(once // len(known.value), np.array(known.value)[once % len(known.value)], minlength=int((word == 0).sum())))
                lines.clear()

            for text in texts:
                own = sentences(text)
                counts.append(len(own))
                lines.extend(f"{s}\n" for s in own)
                size += len(text or "")
                if size > chars:
                    flush()
                    size = 0
            flush()
            return np.concatenate(logits), np.array(counts, np.int64)

        return run


class _Words(dict):
    """word -> number: 0 for a sentence's end, 1 for words without weight, which are most, others their own; scores by number."""

    def __init__(self, weights: np.ndarray):
        self.weight = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}
        self.forget()

    def forget(self) -> None:
        self.clear()
        self["\n"], self.value = 0, [0.0, 0.0]

    def __missing__(self, word: str) -> int:
        own = [self.weight[f] for f in features(word) if f in self.weight]
        k = self[word] = len(self.value) if own else 1
        if own:
            self.value.append(sum(own))
        return k


def noisy_or(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 - prod(1 - sigmoid(z)) over each text's sentences; 0 without a sentence."""
    doc = np.repeat(np.arange(len(counts)), counts)
    return np.minimum(1.0, -np.expm1(-np.bincount(doc, np.logaddexp(0.0, logits), minlength=len(counts))))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def blocks(text: str | None) -> Iterator[tuple[bool, list[int], list[int]]]:
    """The text's sentences in blocks, the last maybe empty: if it is the last, features back to back, how many each sentence has."""
    feats, sizes = [], []
    for s in sentences(text):
        own = [x for w in set(_WORD.findall(s.lower())) for x in features(w)]
        feats += own
        sizes.append(len(own))
        if len(feats) + len(sizes) >= MAX_FEATURES:
            yield False, feats, sizes
            feats, sizes = [], []
    yield True, feats, sizes


def bag(text: str | None) -> tuple[list[int], list[int]]:
    """Features of all sentences of the text, back to back, and how many each has."""
    found = list(blocks(text))
    return [x for _, f, _ in found for x in f], [n for _, _, sizes in found for n in sizes]


BLOCK = "toxic int, last boolean, features array<int>, sizes array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> the text's blocks one after the other, the last one marked."""
    held, size = [], 0
    for batch in batches:
        for toxic, text in zip(batch.column("toxic"), batch.column("text")):
            for last, f, n in blocks(text.as_py()):
                held.append((toxic.as_py(), last, np.array(f, np.int32), np.array(n, np.int32)))
                size += len(f) + len(n)
                if size > BATCH:
                    yield _batch(held)
                    held, size = [], 0
    yield _batch(held)


def _batch(held: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = list(zip(*held)) if held else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["toxic", "last", "features", "sizes"])


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    for batch in batches:
        yield from zip(batch.column("toxic").to_pylist(), batch.column("last").to_pylist(), _views(batch.column("features")), _views(batch.column("sizes")))


def _views(column: pa.ListArray) -> list[np.ndarray]:
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> (feature, texts that have it, its uses); SPACE + label stands for the texts and the sentences of a label."""
    docs, uses, seen = np.zeros(SPACE + 2, np.int64), np.zeros(SPACE + 2, np.int64), np.zeros(SPACE, bool)
    for toxic, last, f, sizes in _rows(batches):
        own, n = np.unique(f, return_counts=True)
        uses[own] += n
        docs[own[~seen[own]]] += 1
        seen[own] = True
        uses[SPACE + toxic] += len(sizes)
        if last:
            docs[SPACE + toxic] += 1
            seen[:] = False
    some = np.flatnonzero(docs + uses)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, docs[some], uses[some])], ["feature", "docs", "uses"])


def loss_and_gradient(w, bias, y, cost, doc, sent, feats, m) -> tuple[float, np.ndarray]:
    """Weighted log loss of the noisy-or of m sentences, and its gradient by weight, the bias last."""
    z = bias + np.bincount(sent, w[feats], minlength=m)
    total = np.bincount(doc, np.logaddexp(0.0, z), minlength=len(y))  # -log of the chance that no sentence is toxic
    safe = np.clip(total, 1e-6, 50.0)
    loss = float((cost * np.where(y > 0, -np.log(-np.expm1(-safe)), total)).sum())
    gz = pull(total, y, cost)[doc] * sigmoid(z)
    return loss, np.append(np.bincount(feats, gz[sent], minlength=len(w)), gz.sum())


def pull(total, y, cost):
    """d loss / d total"""
    return np.where(y > 0, -1.0 / np.expm1(np.clip(total, 1e-6, 50.0)), 1.0) * cost


def costs(texts: np.ndarray) -> np.ndarray:
    """Weight of a text of each label in the loss, from the number of texts of each."""
    return np.array([1 - POSITIVE_SHARE, POSITIVE_SHARE]) / texts


def _packed(bags: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Labels, text of each sentence, sentence and number of each feature, sentences."""
    y = np.array([b[0] for b in bags], np.int64)
    sizes = np.concatenate([b[2] for b in bags])
    doc = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
    sent = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    return y, doc, sent, np.concatenate([b[1] for b in bags]), len(sizes)


def descend(gradient: Callable[[np.ndarray, float], np.ndarray], n: int, steps: int = 150, l1: float = 3e-4, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """Weights and bias after proximal Adam, so that few features keep a weight."""
    w, bias = np.zeros(n), -6.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        g = gradient(w, bias)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
        move = scale * mean / (1 - 0.9**step)
        w = w - move[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - scale[:-1] * l1, 0.0)
        bias -= float(np.clip(move[-1], -0.2, 0.2))
    return w, bias


def _model(used: np.ndarray, w: np.ndarray, bias: float) -> Model:
    weights = np.zeros(SPACE, np.float32)
    weights[used] = w
    return Model(weights, bias)


def fit_bags(bags: list[tuple[int, np.ndarray, np.ndarray]], **rule) -> Model:
    """Train here from (label, features, sentence sizes) of whole texts."""
    texts = np.bincount(np.array([b[0] for b in bags], np.int64), minlength=2)
    if not texts.all():
        return Model(np.zeros(SPACE, np.float32), -np.inf)
    df = np.zeros(SPACE, np.int32)
    for _, f, _ in bags:
        df[np.unique(f)] += 1
    used = df >= MIN_DOCS
    y, doc, sent, feats, m = _packed(bags)
    kept, ids = used[feats], (np.cumsum(used) - 1).astype(np.int32)
    sent, feats, n, cost = sent[kept], ids[feats[kept]], int(used.sum()), costs(texts)[y]
    return _model(used, *descend(lambda w, bias: loss_and_gradient(w, bias, y, cost, doc, sent, feats, m)[1], n, **rule))


def fit_blocks(parts: DataFrame, used: np.ndarray, texts: np.ndarray, **rule) -> Model:
    """Train from blocks where they lie: each step, tasks that hold a block and a vector sum the gradient of whole texts."""
    sc, few = parts.sparkSession.sparkContext, parts.coalesce(TASKS)
    fixed = sc.broadcast((used, costs(texts)))  # fixed size: SPACE booleans

    def gradient(w: np.ndarray, bias: float) -> np.ndarray:
        full = np.zeros(SPACE)
        full[used] = w
        now = sc.broadcast((full, bias))  # fixed size: SPACE numbers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = _slope(_rows(batches), *now.value, fixed.value[1])
            yield pa.RecordBatch.from_arrays([pa.array([np.append(g[:-1][fixed.value[0]], g[-1]).tobytes()], pa.binary())], ["g"])

        got = few.mapInArrow(run, "g binary").toArrow()
        now.destroy()
        return sum((np.frombuffer(g.as_buffer()) for g in got.column("g")), np.zeros(len(w) + 1))

    return _model(used, *descend(gradient, int(used.sum()), **rule))


def _slope(rows: Iterator[tuple[int, bool, np.ndarray, np.ndarray]], w: np.ndarray, bias: float, cost: np.ndarray) -> np.ndarray:
    """The gradient over texts in blocks: texts of one block some at a time, the blocks of a longer one one by one."""
    out, bags, size = np.zeros(len(w) + 1), [], 0
    total, own, within = 0.0, np.zeros(len(w) + 1), False  # of the longer text so far: sum over sentences, its slope

    def flush() -> None:
        if bags:
            y, *packed = _packed(bags)
            out[:] += loss_and_gradient(w, bias, y, cost[y], *packed)[1]
            bags.clear()

    for toxic, last, feats, sizes in rows:
        if last and not within:
            bags.append((toxic, feats, sizes))
            size += len(feats) + len(sizes)
            if size > BATCH:
                flush()
                size = 0
            continue
        sent = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        z = bias + np.bincount(sent, w[feats], minlength=len(sizes))
        total, s, within = total + np.logaddexp(0.0, z).sum(), sigmoid(z), not last
        own += np.append(np.bincount(feats, s[sent], minlength=len(w)), s.sum())
        if last:
            out += float(pull(total, toxic, cost[toxic])) * own
            total, own = 0.0, np.zeros(len(w) + 1)
    flush()
    return out


def _fit(parts: DataFrame) -> Model:
    """Train on the driver if all that can matter is small there, else where the blocks lie; the same sums either way."""
    got = parts.mapInArrow(_counted, "feature long, docs long, uses long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses")).toArrow()  # SPACE + 2 rows
    docs, uses = np.zeros((2, SPACE + 2), np.int64)
    at = got.column("feature").to_numpy()
    docs[at], uses[at] = got.column("docs").to_numpy(), got.column("uses").to_numpy()
    used, texts = docs[:SPACE] >= MIN_DOCS, docs[SPACE:]  # the other features get no weight
    if not texts.all():
        return Model(np.zeros(SPACE, np.float32), -np.inf)
    if uses[:SPACE][used].sum() + uses[SPACE:].sum() > LOCAL_FEATURES:
        return fit_blocks(parts, used, texts)
    mask = parts.sparkSession.sparkContext.broadcast(used)  # fixed size: SPACE booleans

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for toxic, last, f, sizes in _rows([batch]):
                kept = mask.value[f]
                sent = np.repeat(np.arange(len(sizes)), sizes)[kept]
                held.append((toxic, last, f[kept], np.bincount(sent, minlength=len(sizes)).astype(np.int32)))
            yield _batch(held)

    bags, own = [], []
    for toxic, last, f, sizes in _rows(parts.mapInArrow(trimmed, BLOCK).toArrow().to_batches()):
        own.append((f, sizes))
        if last:
            bags.append((toxic, np.concatenate([f for f, _ in own]), np.concatenate([n for _, n in own])))
            own = []
    return fit_bags(bags)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Learn from the labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    own = labels.where("doc_id is not null and toxic is not null").where(fold != 0).groupBy("doc_id").agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").select("doc_id", "toxic")
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        return Model(np.zeros(SPACE, np.float32), -np.inf)
    # the bound holds for distinct texts, however often an id or a row repeats
    able = docs.select("doc_id", F.xxhash64("text").alias("th")).join(own, "doc_id").distinct()
    picked = [able.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "th").limit(max_per_class) for k in (0, 1)]
    few = F.broadcast(checkpointed(picked[0].unionByName(picked[1])))  # 2 * max_per_class rows
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).join(few, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]).select("toxic", "text")
    # a partition keeps its order in the checkpoint, so that the blocks of a text stay together
    return _fit(checkpointed(rows.mapInArrow(_blocks, BLOCK)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns plus score double, n_sentences int, worst_sentence int (0-based; null if none), worst_score double."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: SPACE floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = shared.value.scorer()
        for batch in batches:
            z, counts = scored(strings(batch.column("text")))
            ends = np.cumsum(counts).tolist()
            worst = [int(z[e - n : e].argmax()) if n else None for e, n in zip(ends, counts.tolist())]
            most = [None if w is None else float(sigmoid(z[e - n + w])) for w, e, n in zip(worst, ends, counts.tolist())]
            extra = [pa.array(noisy_or(z, counts), pa.float64()), pa.array(counts, pa.int32()), pa.array(worst, pa.int32()), pa.array(most, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *extra], [*(batch.schema.names[i] for i in keep), *ADDED])
        tidy()

    keep = [i for i, c in enumerate(docs.columns) if c not in ADDED]
    fields = ", ".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep)
    return docs.mapInArrow(run, f"{fields}, score double, n_sentences int, worst_sentence int, worst_score double")


ADDED = ("score", "n_sentences", "worst_sentence", "worst_score")


def reject(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array(noisy_or(*scored(strings(batch.column(at)))) < threshold))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def offending_sentences(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence int, text, score): the sentences that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored, least = shared.value.scorer(), np.log(threshold / (1 - threshold))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            z, counts = scored(texts)
            out, at = [], 0
            for d, text, n in zip(batch.column("doc_id").to_pylist(), texts, counts.tolist()):
                own = z[at : at + n]
                if n and own.max() >= least:
                    out += [(d, i, s, float(sigmoid(x))) for i, (s, x) in enumerate(zip(sentences(text), own)) if x >= least]
                at += n
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()))], ["doc_id", "sentence", "text", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence int, text string, score double")


def predicted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels, score all documents."""
    return score(docs, train(docs, labels)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = predicted(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence", "worst_score")
