"""Line dedup, SimHash, mixing, BPE and toxicity against brute force."""

import hashlib
import random
import re

import pytest

from quillstone.llm import bpe, linededup, mixing, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, score double"
RND = random.Random(5)
WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "x", 1, 0.5)


EDGE = [doc(1, None), doc(2, ""), doc(3, "  \n\t "), doc(4, "one"), doc(None, prose(40), None), doc(5, "two words"), doc(5, "two words")]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def corpus():
    base = [prose(RND.randint(20, 200)) for _ in range(30)]
    rows = [doc(i + 10, t, RND.choice("abc")) for i, t in enumerate(base)]
    rows += [doc(100 + i, base[0], "a") for i in range(5)]
    rows += [doc(200 + i, base[1] + " " + prose(1), "b") for i in range(5)]
    return rows + EDGE


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash_matches_brute_force(spark):
    rows = corpus()
    prints = [(r[0], simhash.simhash64(r[1])) for r in rows]
    n = range(len(prints))
    root = components(n, [(i, j) for i in n for j in n if i < j and bin(prints[i][1] ^ prints[j][1]).count("1") <= 2])
    best = {}
    for i in n:
        ids = [prints[j][0] for j in n if root[j] == root[i] and prints[j][0] is not None]
        best[i] = min(ids) if ids else None
    want = sorted(((p[0], f"{p[1]:016x}", best[i]) for i, p in zip(n, prints)), key=str)
    got = sorted(((r[0], r[1], r[2]) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == want
    kept = simhash.keep_one_per_group(frame(spark, rows)).collect()
    assert len(kept) == len({root[i] for i in n}) and kept[0].__fields__ == [f.split()[0] for f in DOCS.split(', ')]


def test_fingerprint_by_definition():
    import xxhash

    text = "The Quick brown\tfox ÄÖ jumps"
    w = ["the", "quick", "brown", "fox", "ÄÖ", "jumps"]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(4)]
    assert simhash.simhash64(text) == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 4)
    assert simhash.simhash64(None) == simhash.simhash64("") == simhash.simhash64(" \n") == 0
    assert simhash.simhash64("One two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("flips", [(0,), (63,), (0, 63), (31, 32)])
def test_ball_links_every_pair_within_two_bits(spark, flips):
    a = 0x9234567890ABCDEF - (1 << 64)
    b = a
    for f in flips:
        b ^= (1 << f) - (1 << 64 if f == 63 else 0)
    got = simhash.fingerprint_groups(spark.createDataFrame([(7, a), (3, b)], "doc_id long, fp long")).collect()
    assert {r["component_id"] for r in got} == {3} and len(got) == 2


def test_ball_links_at_a_wider_radius(spark):
    rnd = random.Random(8)
    a = rnd.getrandbits(63)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(63), n))
    fps = [a, flip(a, 3), flip(a, 4), flip(a, 9)] + [rnd.getrandbits(63) for _ in range(20)]
    n = range(len(fps))
    root = components(n, [(i, j) for i in n for j in n if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4])
    got = {r["fp"]: r["component_id"] for r in simhash.fingerprint_groups(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long"), 4).collect()}
    assert [got[f] for f in fps] == [min(j for j in n if root[j] == root[i]) for i in n]
    with pytest.raises(ValueError):
        simhash.fingerprint_groups(spark.createDataFrame([(1, 1)], "doc_id long, fp long"), 3)


def template_keys(line):
    own = re.findall(r"[^ \t-\r]+", line)
    tk = ["<*>" if re.search("[0-9]", t) else t for t in own]
    if not "".join(tk).replace("<*>", ""):
        tk = own
    n = len(tk)
    if n <= 3:
        return [(4, *tk)] if n else []
    at = [3 + (n - 3) * j // 4 for j in range(5)]
    return [(j, n, *tk[: at[j]], None, *tk[at[j + 1] :]) for j in range(4) if at[j + 1] > at[j]]


def line_dedup(rows):
    """[(doc_id, text, lines, dropped)] by the definition."""
    split = lambda t: re.split("\r\n|\n|\r", t) if t is not None else []
    me = lambda r: -1 if r[0] is None else r[0]
    docs, count, taken, least = {}, {}, {}, {}
    for r in rows:
        for line in split(r[1]):
            for k in template_keys(line):
                docs.setdefault(k, set()).add(me(r))
                count[k] = count.get(k, 0) + 1
    for r in rows:
        for line in split(r[1]):
            able = [k for k in template_keys(line) if len(docs[k]) > 1]
            if able:
                taken[line] = max(able, key=lambda k: (count[k], -k[0]))
                least[taken[line]] = min(least.get(taken[line], me(r)), me(r))
    out = []
    for r in rows:
        lines = split(r[1])
        stay = [x for x in lines if x not in taken or me(r) == least[taken[x]]]
        out.append((r[0], r[1] if len(stay) == len(lines) else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def dropped(spark, rows):
    got = linededup.drop_recurring_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted(map(tuple, got), key=str)


def test_line_dedup_matches_brute_force(spark):
    shared = ["Licensed under the X License, version 2.", "user 17 logged in", prose(60), "Les.", "1 2 3 4"]
    rows = list(EDGE)
    for i in range(40):
        lines = [prose(RND.randint(1, 30)) for _ in range(5)]
        lines += [RND.choice(shared).replace("17", str(i)), "", shared[2].rsplit(" ", 2)[0] + f" odd{chr(97 + i % 20)} end", "a b", f"x y z {RND.choice('pqr')} {RND.choice('pqr')}"]
        RND.shuffle(lines)
        rows.append(doc(i + 10, RND.choice(["\n", "\r\n"]).join(lines)))
    rows.append(rows[-1])
    want = line_dedup(rows)
    assert dropped(spark, rows) == sorted(want, key=str)
    assert sum(w[3] for w in want) > 100


def test_line_dedup_keeps_a_relative_of_every_line(spark):
    """Lines that drift quarter by quarter: what goes shares a template with a line that stays."""
    drift = ["h i j a a b b c c d d", "h i j z z b b c c d d", "h i j z z y y c c d d", "h i j z z y y x x d d", "h i j z z y y x x w w"]
    rows = [doc(i + 1, line) for i, line in enumerate(drift)]
    got = {r[0]: r[1] for r in dropped(spark, rows)}
    stay = [t for t in got.values() if t]
    assert got[1] == drift[0] and all(got[i + 1] or any(set(template_keys(drift[i])) & set(template_keys(t)) for t in stay) for i in range(5))
    assert len(stay) < 5


def test_line_dedup_has_one_rule_for_all_lengths(spark):
    """A changed word in the body is a field in short lines too; a leading token is none."""
    rows = [doc(20, "1 2 " * 100_000), doc(1, "lead one two p q r s\nlead one two x\nLes.\n7 8"), doc(2, "lead one two p q r t\nlead one two y\nLes.\n7 9"), doc(3, "lead one odd p q r s\nlead two two x\nLes .\n7 9")]
    got = {r[0]: r[1] for r in dropped(spark, rows)}
    assert got == {20: rows[0][1], 1: rows[1][1], 2: "7 9", 3: "lead one odd p q r s\nlead two two x\nLes ."}


def test_pipeline_drops_recurring_short_lines(spark):
    import corpus_pipeline

    rows = [doc(1, "Les.\n\nAnd ornd.\nx"), doc(2, "Les.\n\n  \ny z"), doc(3, "And ornd.\r\n7\na b c"), doc(4, "9\nz y\na b c"), doc(5, ""), doc(6, "7\nz 1"), doc(7, "z 2")]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, frame(spark, rows), "").collect()}
    assert got == {1: rows[0][1], 2: "\n  \ny z", 3: "7\na b c", 4: "9\nz y", 5: "", 6: "z 1", 7: ""}


def test_line_dedup_is_native(spark):
    plan = linededup.drop_recurring_lines(frame(spark, EDGE))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over


def test_mixing(spark):
    rows = [doc(i, prose(RND.randint(0, 50)), RND.choice("aaaaaabcd")) for i in range(3000)] + EDGE
    rows += [doc(9000 + i, prose(4), "tiny") for i in range(2)]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^ \t-\r]+", r[1] or ""))
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want, taken = brute_targets(sizes), {}
    for r in out:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["copies"] <= 3
        taken[s] = taken.get(s, 0) + r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 60
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    key = lambda r: (str(r["row"]["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_mixing_hash_parts_keep_ranks(spark, monkeypatch):
    rows = frame(spark, [doc(i, "a b", "a") for i in range(400)] + [doc(1000 + i, prose(30), "b") for i in range(50)])
    key = lambda r: (r["row"]["doc_id"], r["copies"])
    want = sorted(map(key, mixing.mix(rows).collect()))
    monkeypatch.setattr(mixing, "GROUP", 10)
    assert sorted(map(key, mixing.mix(rows).collect())) == want


TRICKY = ["it's I'll we'VE", "a  b   c\n\n d\t\te ", "<|endoftext|>x <|endoftext|>", "naïve Straße ½ ²³ Ⅷ", "日本語 текст 🙂🙂 é", "x y  z\u0085q", "\x1c\x1d a\x1fb", "###  !!!%%%", " lead", "trail ", "", "ﬀ ǅ ǆ × ÷ Ɋ"]


def test_bpe_equals_the_library(spark):
    rows = corpus() + [doc(500 + i, t) for i, t in enumerate(TRICKY)] + [doc(600, prose(20000)), doc(601, "x" * 30000)]
    t = bpe.tokenizer(bpe.default_vocabulary())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    got = bpe.encode_decode(frame(spark, rows), bpe.default_vocabulary()).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_bpe_many_blocks_and_ids(spark, monkeypatch):
    rows = [doc(i, prose(50)) for i in range(60)]
    got = bpe.encode_decode(frame(spark, rows), bpe.default_vocabulary(), keep_ids=True).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(r["decoded"] == text[r["doc_id"]] and len(r["ids"]) == r["n_tokens"] for r in got) and len(got) == 60


def test_bpe_odd_rows(spark):
    """Null ids beside given ones, ids kept, other columns of clashing names."""
    rows = spark.createDataFrame([(None, "a b"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as k", "'y' as blob", "2 as n_tokens")
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids"], r["decoded"]) for r in bpe.encode_decode(rows, bpe.default_vocabulary(), keep_ids=True).collect()), key=str)
    ids = bpe.tokenizer(bpe.default_vocabulary()).encode("a b", add_special_tokens=False).ids
    assert got == sorted([(None, 2, ids, "a b"), (None, 0, [], ""), (3, 2, ids, "a b"), (3, 2, ids, "a b")], key=str)


def test_bpe_fails_if_the_words_are_others(spark):
    """Another read gave as many words, but not the same ones."""
    import pyarrow as pa

    batch = lambda text: pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    one, two = (pa.Table.from_batches(list(bpe._splitter(1, ())(iter([batch(t)])))) for t in ("some words here", "some words there"))
    path = bpe.default_vocabulary()
    words = lambda t: t.filter(pa.compute.equal(t["part"], 0))
    docs = one.filter(pa.compute.equal(one["part"], -1))
    assert bpe._joiner(path, False)(docs, bpe._encoder(path)(words(one))).num_rows == 1
    with pytest.raises(RuntimeError):
        bpe._joiner(path, False)(docs, bpe._encoder(path)(words(two)))


def test_split_equals_general_pattern():
    chars = "ab'sZé9 \t\n\r.,!ß½ 中\x1c_"
    for _ in range(3000):
        s = "".join(RND.choice(chars) for _ in range(RND.randint(0, 12)))
        assert bpe.split_words(s) == bpe._GENERAL.findall(s)


def test_toxicity(spark):
    bad = ["zorgface", "zorghead", "plonk"]
    rows, labels = list(EDGE), [(None, 1), (4, None), (900001, 1)]
    for i in range(600):
        y = i % 4 == 0
        lines = [prose(RND.randint(3, 12)) for _ in range(6)]
        if y:
            lines[i % 6] += f" {RND.choice(bad)} {prose(2)}"
        rows.append(doc(1000 + i, ". ".join(lines)))
        if i < 500:
            labels.append((1000 + i, int(y)))
    docs, labs = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, labs)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and set(got[0].__fields__) >= {"doc_id", "score", "fp"}
    mine = {r["doc_id"]: r for r in got}
    right = sum((mine[1000 + i]["score"] >= 0.5) == (i % 4 == 0) for i in range(500, 600))
    assert right >= 97
    assert mine[1]["score"] == mine[2]["score"] == 0.0 and mine[1]["worst_sentence"] is None
    found = {(r["doc_id"], r["sentence"]) for r in toxicity.offending_sentences(docs, model).collect()}
    hits = [i for i in range(500, 600) if i % 4 == 0 and (1000 + i, i % 6) in found]
    assert len(hits) >= 23
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r["score"] < 0.5 for r in got)


@pytest.mark.parametrize("run", [
    simhash.near_duplicates, simhash.keep_one_per_group, linededup.drop_recurring_lines, mixing.mix, mixing.mixed,
    lambda d: bpe.encode_decode(d, bpe.default_vocabulary()),
    lambda d: toxicity.score(d, toxicity.train(d, d.selectExpr("doc_id", "size as toxic"))),
])
def test_empty_table(spark, run):
    assert run(frame(spark, [])).collect() == []


@pytest.mark.parametrize("run", [simhash.keep_one_per_group, linededup.drop_recurring_lines, mixing.mixed])
def test_clashing_columns_pass_through(spark, run):
    rows = frame(spark, corpus()).selectExpr("*", "'keep' as d", "'keep' as row", "'keep' as lines", "'keep' as copies", "'keep' as _source")
    out = run(rows)
    assert {(r["d"], r["row"], r["lines"], r["copies"], r["_source"]) for r in out.collect()} == {("keep",) * 5}


def test_long_texts_are_hashed_once_not_once_a_line(spark):
    """The text's hash lies below the generator of its lines, so a text of many lines costs no more than its length."""
    from quillstone.llm import linededup

    docs = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b c")], "doc_id long, text string")
    plan = linededup._lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("xxhash64") > plan.rindex("Generate posexplode")
