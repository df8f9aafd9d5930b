"""The pipeline, stage by stage and as a whole, against plain code on a small corpus."""

import hashlib
import random
import re
import zlib

import pytest
from test_text_ops import brute_targets, components, line_dedup

import corpus_pipeline
from quillstone.llm import bpe, mixing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, d string, score string"
WORD = r"[^ \t-\r]+"


def corpus():
    rnd = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(160):
        lines = [prose(rnd.randint(4, 20)) + "." for _ in range(4)] + [rnd.choice(["Shared line of all.", "Page 1 of 9", ""])]
        if i % 4 == 0:
            lines[i % 3] += f" {rnd.choice(['zorgface', 'plonk'])}"
        labels.append((i, int(i % 4 == 0)))
        rows.append((i, "\n".join(lines), rnd.choice("ab")))
    base = rows[33][1]
    rows += [(200 + i, base, "b") for i in range(4)] + [(220, prose(80) + "\n" + base, "c"), (221, None, "a"), (222, "", None), (223, " \n ", "c"), (None, prose(30), None), (None, prose(30), "a"), (224, prose(3), None)]
    rows += [rows[41], rows[41]]
    return [(d, t, "en", s, len(t or ""), "keep", "keep", "keep") for d, t, s in rows], labels


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def toxic(rows, labels):
    """Learnt and scored without Spark."""
    label = dict(labels)
    seen = sorted({(r[0], r[1]) for r in rows if r[0] in label and zlib.crc32(str(r[0]).encode()) % 5}, key=str)
    bags = [(label[d], *map(toxicity.np.array, toxicity.bag(t))) for d, t in seen]
    z, n = toxicity.fit_bags(bags).scorer()([r[1] for r in rows])
    return toxicity.noisy_or(z, n) >= 0.5


def near(rows):
    fp = [simhash.simhash64(r[1]) for r in rows]
    n = range(len(rows))
    root = components(n, [(i, j) for i in n for j in n if i < j and bin(fp[i] ^ fp[j]).count("1") <= 2])
    ids = {}
    for i in n:
        ids.setdefault(root[i], []).append(rows[i][0])
    return [(rows[i], root[i], min((x for x in ids[root[i]] if x is not None), default=None)) for i in n]


def words(t):
    return len(re.findall(WORD, t or ""))


def mixed(rows):
    """Copies of each row by sorting whole sources."""
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    target, out = brute_targets(sizes), []
    for source, total in sizes.items():
        start = int(hashlib.md5((mixing.SEED + ("1" if source is not None else "0") + (source or "")).encode()).hexdigest()[:8], 16) / 2**32
        name = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]} {hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()
        own = sorted((r for r in rows if r[3] == source), key=lambda r: (words(r[1]), name(r)))
        rate = target[source] / total if total else 0.0
        for i, r in enumerate(own):
            out += [r] * (int(start + rate * (i + 1)) - int(start + rate * i))
    return out


def same(got, want):
    return sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_stages_equal_brute_force(spark, tmp_path):
    rows, labels = corpus()
    sf = tables(spark, tmp_path, rows, labels)
    stage = {name: lambda some, f=f: f(spark, spark.createDataFrame(some, DOCS), sf) for name, f in corpus_pipeline.STAGES}
    clean = [r for r, bad in zip(rows, toxic(rows, labels)) if not bad]
    assert 20 < len(rows) - len(clean) < 60
    out = stage["toxicity"](rows)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and same(out.collect(), clean)
    short = [(d, t, *r[2:4], None if t is None else len(t), *r[5:]) for r, (d, t, *_) in zip(clean, line_dedup(clean))]
    out = stage["line dedup"](clean)
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")] and same(out.collect(), short) and short != clean
    kept = [tuple(r) for r in stage["simhash near-dedup"](short).collect()]
    groups = near(short)
    assert len(kept) == len({g for _, g, _ in groups}) < len(short)
    assert set(kept) <= {r for r, _, least in groups if r[0] == least}
    emitted = mixed(kept)
    assert same(stage["mixing"](kept).collect(), emitted) and len(emitted) > 20
    t = bpe.tokenizer(bpe.default_vocabulary())
    want = []
    for r in emitted:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert same(stage["bpe"](emitted).collect(), want)
    assert same(corpus_pipeline.run(spark, sf).collect(), want)  # each stage on all that its predecessor kept


def test_a_run_resumes_where_it_stopped(spark, tmp_path, monkeypatch):
    rows, labels = corpus()
    sf = tables(spark, tmp_path, rows[:40], labels)
    did, fail = [], ["mixing"]

    def watched(name, f):
        def stage(*args):
            did.append(name)
            if name in fail:
                raise RuntimeError("stopped")
            return f(*args)

        return stage

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f)) for n, f in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, sf, "one")
    fail.clear()
    did.clear()
    got = corpus_pipeline.run(spark, sf, "one").collect()
    assert did == ["mixing", "bpe"]
    assert same(got, corpus_pipeline.run(spark, sf).collect()) and len(did) == 7


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [])).collect() == []
