"""BPE encoding and decoding over a distinct-word table.

Texts are split into words by the byte-level pattern of the vocabulary.  Tokenising words apart gives the same
ids as tokenising the text, so each word needs encoding once:

1. *Split.*  Each task packs its documents into blocks of bounded text.  A block keeps its sorted distinct words,
   dealt by hash into parts (their number follows the input's size), and its documents as positions in that word list.
2. *Encode.*  A part holds the words of one hash range from all blocks; each distinct word of it is encoded once
   with the tokenizer, and its ids go back to the blocks that asked.
3. *Join back.*  A block meets the ids of its words, which carry a digest of the words that were encoded: if it is not
   that of the block's words, because the input changed between two reads, the operator fails.  Decoding joins the
   words' ids to the id-to-piece table (vocabulary-sized, so bounded) and the words' bytes back by position.

Steps 1 to 3 use two shuffles of packed, compressed rows.  A word is in a part at most once a block, so frequent
words do not skew; a block is bounded by its text, except that one longer document is a block of its own.

Edge cases: null and empty texts have no ids (hash of the empty string); the special token's text in a document
is the special id, as the tokenizer has it; repeated rows and null ids come back as they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import shuffle_partitions, strings, table, tidy

#: Fixed value: the vocabulary's split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GENERAL = regex.compile(PATTERN)
# The same where all characters are ASCII or Latin letters up to U+024F: there classes are short ranges.
_L, _S = "A-Za-zÀ-ÖØ-öø-ɏ", "\t-\r "
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}0-9{_L}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile(f"[^\x00-\x7f{_L[6:]}]")
#: Text of a block, in characters.
BLOCK = 8_000_000
BLOCK_KEY = 1 << 40
PART_BYTES = 32_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for _, t in sorted(tokenizer(path).get_added_tokens_decoder().items()))


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[bytes, ...]:
    """id -> bytes.  Fixed values: byte-level vocabularies write byte b as a printable character: itself, or chr(256 + k) for the k-th other."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    t, special = tokenizer(path), set(specials(path))
    out = []
    for i in range(t.get_vocab_size()):
        p = t.id_to_token(i) or ""
        out.append(p.encode() if p in special else bytes(byte[c] for c in p))
    return tuple(out)


def split_words(text: str, special: tuple[str, ...] = ()) -> list[str]:
    found = [s for s in special if s in text]
    if found:
        out: list[str] = []
        for i, part in enumerate(re.split("(" + "|".join(map(re.escape, found)) + ")", text)):
            out += [part] if i % 2 else split_words(part)
        return out
    return (_GENERAL if _BEYOND.search(text) else _LATIN).findall(text)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, byte planes apart, compressed."""
    out = [struct.pack("<I", len(arrays))]
    for a in arrays:
        out += [struct.pack("<cQ", a.dtype.char.encode(), len(a)), a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()]
    return zstandard.compress(b"".join(out), 3)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 4, []
    for _ in range(struct.unpack_from("<I", raw)[0]):
        kind, n = struct.unpack_from("<cQ", raw, at)
        dtype = np.dtype(kind.decode())
        end = (at := at + 9) + n * dtype.itemsize
        out.append(np.frombuffer(raw[at:end], np.uint8).reshape(dtype.itemsize, n).T.copy().view(dtype).reshape(n))
        at = end
    return out


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    sizes = _pack(np.array([len(d) for d in data], np.uint32))
    return struct.pack("<I", len(sizes)) + sizes + zstandard.compress(b"".join(data), 3)


def _unpack_words(blob: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", blob)[0]
    ends = np.cumsum(_unpack(blob[4 : 4 + n])[0], dtype=np.int64)
    data, out, a = zstandard.decompress(blob[4 + n :]), [], 0
    for b in ends.tolist():
        out.append(data[a:b])
        a = b
    return out


def _digest(words: bytes) -> int:
    return xxhash.xxh64_intdigest(words)


_ROWS = "k long, src long, part int, words binary, ids binary, blob binary"
_ARROW = pa.schema([("k", pa.int64()), ("src", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("ids", pa.binary()), ("blob", pa.binary())])


def _splitter(parts: int, special: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        state: dict = {"block": (task.partitionId() if task else 0) << 12}

        def fresh() -> None:
            state.update(words={}, ids=[], seqs=[], size=0)

        def flush() -> Iterator[pa.RecordBatch]:
            if not state["ids"]:
                return
            state["block"] += 1
            block, seen = state["block"], state["words"]
            dealt: list[list[str]] = [[] for _ in range(parts)]
            for w in sorted(seen):
                dealt[zlib.crc32(w.encode()) % parts].append(w)
            place, at, rows = np.empty(len(seen), np.uint32), 0, []
            for p, own in enumerate(dealt):
                for w in own:
                    place[seen[w]] = at
                    at += 1
                if own:
                    rows.append((p, block, p, _pack_words(own), None, None))
            digests = np.array([_digest(r[3]) for r in rows], np.uint64)
            has = np.array([d is not None for d in state["ids"]], np.uint8)
            ids = np.array([d or 0 for d in state["ids"]], np.int64)
            sizes = np.array([len(s) for s in state["seqs"]], np.uint32)
            seq = place[np.concatenate(state["seqs"])] if at else np.empty(0, np.uint32)
            dealt_to = _pack(np.array([r[2] for r in rows], np.int32), digests)
            rows.append((BLOCK_KEY + block, block, -1, dealt_to, _pack(ids, has, sizes), _pack(seq)))
            cols = list(zip(*rows))
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
            del rows, cols, dealt, place, seq
            fresh()
            yield batch
            tidy()

        fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                text = text or ""
                if state["size"] and state["size"] + len(text) > BLOCK:
                    yield from flush()
                seen = state["words"]
                words = split_words(text, special)
                for w in words:
                    if w not in seen:
                        seen[w] = len(seen)
                state["seqs"].append(np.fromiter(map(seen.__getitem__, words), np.uint32, len(words)))
                state["ids"].append(doc_id)
                state["size"] += len(text)
        yield from flush()

    return run


def _encoder(path: str):
    def run(group: pa.Table) -> pa.Table:
        asks = [(r["src"], r["part"], _digest(r["words"]), _unpack_words(r["words"])) for r in group.select(["src", "part", "words"]).to_pylist() if r["part"] >= 0]
        place: dict[bytes, int] = {}
        for *_, words in asks:
            for w in words:
                place.setdefault(w, len(place))
        distinct, sizes, flats = list(place), [], []
        for i in range(0, len(distinct), 2_000):
            got = [e.ids for e in tokenizer(path).encode_batch([w.decode() for w in distinct[i : i + 2_000]], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flats.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        size, flat = (np.concatenate([np.empty(0, k), *v]) for k, v in ((np.int64, sizes), (np.uint32, flats)))
        start = np.cumsum(size) - size
        rows = []
        for block, part, digest, words in asks:
            own = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
            n = size[own]
            ids = flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            rows.append((BLOCK_KEY + block, block, part, _pack(np.array([digest], np.uint64)), _pack(n.astype(np.uint32), ids), None))
        del asks, place, distinct, flat
        tidy()
        cols = list(zip(*rows)) if rows else [[] for _ in _ARROW]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _joiner(path: str, keep_ids: bool):
    schema = _RESULT.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string())) if keep_ids else _RESULT

    def run(docs: pa.Table, encoded: pa.Table) -> pa.Table:
        rows = []
        mine = [r for r in docs.select(["src", "words", "ids", "blob"]).to_pylist() if r["blob"] is not None]
        if mine:
            given = {r["part"]: (int(_unpack(r["words"])[0][0]), r["ids"]) for r in encoded.select(["part", "words", "ids"]).to_pylist()}
            word_ids, word_pieces, count_of = _words(path, [given[p][1] for p in sorted(given)])
            for r in mine:
                parts, digests = _unpack(r["words"]) if r["words"] is not None else ([], [])
                if dict(zip(parts.tolist(), digests.tolist())) != {p: d for p, (d, _) in given.items()}:
                    raise RuntimeError("a block's words are not those that were encoded: the input changed between two reads")
                ids, has, sizes = _unpack(r["ids"])
                seq = _unpack(r["blob"])[0]
                ends = np.cumsum(sizes, dtype=np.int64)
                for a, b in _spans(sizes):
                    at = ends[a] - sizes[a]
                    words = pa.array(seq[at : ends[b - 1]])
                    offsets = pa.array(np.concatenate(([0], ends[a:b] - at)), pa.int64())
                    as_text = _joined(word_ids, words, offsets, ",")
                    as_bytes = _joined(word_pieces, words, offsets, b"")
                    n = np.concatenate(([0], np.cumsum(count_of[seq[at : ends[b - 1]]], dtype=np.int64)))
                    tokens = n[ends[a:b] - at] - n[ends[a:b] - at - sizes[a:b]]
                    for i in range(a, b):
                        text, raw = as_text[i - a].as_buffer(), as_bytes[i - a].as_buffer()
                        decoded = None
                        try:
                            str(raw, "utf-8")
                        except UnicodeDecodeError:
                            decoded = str(raw, "utf-8", "replace")
                        row = (int(ids[i]) if has[i] else None, int(tokens[i - a]), hashlib.sha256(text).hexdigest(), hashlib.sha256(raw if decoded is None else decoded.encode()).hexdigest())
                        rows.append((*row, [int(x) for x in str(text, "utf-8").split(",")] if text.size else [], decoded or str(raw, "utf-8", "replace")) if keep_ids else row)
        tidy()
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _words(path: str, packed: list[bytes]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Of each word: its ids as text, its pieces as bytes (ids joined to the id-to-piece table), the number of ids."""
    both = [_unpack(p) for p in packed]
    sizes = np.concatenate([np.empty(0, np.uint32), *(b[0] for b in both)])
    ids = pa.array(np.concatenate([np.empty(0, np.uint32), *(b[1] for b in both)]))
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), pa.int64())
    table = piece_table(path)
    return _joined(table.column("digits").chunk(0), ids, offsets, ","), _joined(table.column("piece").chunk(0), ids, offsets, b""), sizes.astype(np.int64)


def _joined(values: pa.Array, at: pa.Array, offsets: pa.Array, by: str | bytes) -> pa.Array:
    """The values at positions ``at``, concatenated list by list."""
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.take(at)), pa.scalar(by, values.type))


def _spans(sizes: np.ndarray, most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about that many words at most."""
    a = total = 0
    for b, n in enumerate(sizes.tolist()):
        if b > a and total + n > most:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


@lru_cache(maxsize=4)
def piece_table(path: str) -> pa.Table:
    """(digits, piece) by id: the id as text and the bytes that it stands for."""
    found = pieces(path)
    return pa.table({"digits": pa.array([str(i) for i in range(len(found))], pa.large_string()), "piece": pa.array(found, pa.large_binary())})


def parts_for(docs: DataFrame) -> int:
    """Hash ranges of the word table: one for each PART_BYTES of input by the optimizer's estimate, as many as shuffle partitions at least."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 50 else 0  # no estimate: a huge number
    return max(shuffle_partitions(docs.sparkSession), -(-known // PART_BYTES))


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> (doc_id, n_tokens, ids_sha256, decoded_sha256), with keep_ids also ids and decoded."""
    split = docs.select("doc_id", "text").mapInArrow(_splitter(parts_for(docs), specials(path)), _ROWS)
    encoded = split.groupBy("k").applyInArrow(_encoder(path), _ROWS)
    result = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return split.groupBy("k").cogroup(encoded.groupBy("k")).applyInArrow(_joiner(path, keep_ids), result)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), default_vocabulary())
