"""Vectors, pages, rollups and chat pairs against brute force."""

import hashlib

import numpy as np
import pytest

from quillstone.llm import ann, caps, chat, html, rollups

EMB = "vec_id long, embedding array<float>, label int, c string, q string, f string"
RNG = np.random.default_rng(3)


def vectors(n=400, d=16):
    x = RNG.standard_normal((n, d))
    x[100:140] = x[100] + 0.05 * RNG.standard_normal((40, d))  # near copies
    x[200:230] = x[200]  # copies
    rows = [(i, [float(v) for v in e], int(i % 3 == 0), "x", "y", "z") for i, e in enumerate(x.astype(np.float32))]
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0, 2.0]]
    rows += [(1000 + i, e, 1, "x", "y", "z") for i, e in enumerate(odd)]
    return rows + [(None, rows[0][1], 0, "x", "y", "z"), (2000, rows[0][1], None, "x", "y", "z"), rows[5]]


def test_ann_recall_and_exact_scores(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, EMB)
    got = ann.search(df.select("vec_id", "embedding"), df.where("vec_id % 10 = 0").select("vec_id", "embedding")).collect()
    own = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and (r[0] < 1000 or r[0] == 2000)}
    ids = np.array(sorted(own))
    x = np.stack([own[i] for i in ids])
    hits = total = 0
    for q in [i for i in ids if i % 10 == 0]:
        s = x @ own[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(own[q]))
        order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in mine] == sorted((r["score"] for r in mine), reverse=True)
        for r in mine:
            assert r["score"] == pytest.approx(s[np.searchsorted(ids, r["vec_id"])], abs=1e-12)
        hits += len({r["vec_id"] for r in mine} & {int(ids[i]) for i in order})
        total += 5
    assert hits / total >= 0.9
    copies = [r["vec_id"] for r in got if r["query_id"] == 220]
    assert copies == [200, 201, 202, 203, 204]  # ties to the smaller id


def test_ann_misses_no_neighbour(spark, monkeypatch):
    """Random directions, a tight bunch with an offset and repeated rows, most of them outside the sample: the five truly nearest of every query."""
    monkeypatch.setattr(ann, "SAMPLE", 200)
    monkeypatch.setattr(ann, "SHARD", 256)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 48))
    x[600:] = x[0] + 1e-3 * rng.normal(size=(600, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:30] * 3, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 10 = 0")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, len(x), 10):
        s = u @ u[q]
        s[q] = -2
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == np.argsort(-s)[:5].tolist()


def test_caps_equal_brute_force(spark):
    rows = vectors()
    got = {}
    for r in caps.near_duplicates(spark.createDataFrame(rows, EMB).select("vec_id", "embedding", "label")).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    fine = [r for r in rows if r[0] is not None and r[0] < 1000 and r[2] is not None]
    x = np.array([r[1] for r in fine], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label, ids = np.array([r[2] for r in fine]), np.array([r[0] for r in fine])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    root = np.arange(len(ids))
    for _ in range(50):
        root = np.minimum(root, np.where(close, root[None, :], len(ids)).min(axis=1))
    least = {r: ids[root == r].min() for r in set(root)}
    for i, v in enumerate(ids):
        assert (close[i].sum(), least[root[i]], v == least[root[i]]) in got[v], v
    assert len(got[5]) == 2 and got[2000] == [(0, 2000, True)] and got[None] == [(0, None, False)]
    assert got[1000] == [(0, 1000, True)] and sum(map(len, got.values())) == len(rows)


def test_caps_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 8)
    test_caps_equal_brute_force(spark)


@pytest.mark.parametrize("rows", [2_000, 65_000, 66_000, 1_000_000, 30_000_000])  # below and above 65 536 the number of filters is fixed and grows
def test_caps_lose_no_pair_at_the_threshold(rows):
    filters = caps.Filters(64, rows)
    x, y = caps.pairs_at(0.93, 64, 3000, seed=8)
    f, g = filters.decode(x), filters.decode(y)
    assert f.shape[1] == caps.PASSES * len(filters.codes)  # every vector is in as many filters
    assert (f[:, :, None] == g[:, None, :]).any(axis=(1, 2)).mean() >= 0.999
    bits = np.bitwise_count(filters.sketch(x).view(np.uint64) ^ filters.sketch(y).view(np.uint64)).sum(axis=1)
    assert (bits <= filters.reach).all()


def test_other_lengths_and_unusable_tables(spark):
    """Lengths are compared by themselves; tables without a usable vector work; scaled copies tie."""
    rows = [(1, [1.0, 2.0], 0, "", "", ""), (2, [2.0, 4.0], 0, "", "", ""), (50, [1.0, 2.0, 3.0], 0, "", "", ""), (4, [3.0, 6.0, 9.0], 0, "", "", ""), (100, [4.0, 8.0], 0, "", "", "")]
    df = spark.createDataFrame(rows, EMB)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 100: (2, 1), 50: (1, 4), 4: (1, 4)}
    found = ann.search(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == [(50, 1, 4), (100, 1, 1), (100, 2, 2)]
    none = spark.createDataFrame([(1, None, 0, "", "", ""), (50, [0.0, 0.0], 0, "", "", ""), (3, [], None, "", "", "")], EMB)
    assert ann.search(none, none).collect() == []
    assert sorted((r["vec_id"], r["n_links"], r["kept"]) for r in caps.near_duplicates(none).collect()) == [(1, 0, True), (3, 0, True), (50, 0, True)]


def test_ann_large_lists_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 16)
    test_ann_recall_and_exact_scores(spark)


@pytest.mark.parametrize("run", [
    lambda s: ann.search(s.createDataFrame([], EMB), s.createDataFrame([], EMB)),
    lambda s: caps.near_duplicates(s.createDataFrame([], EMB)),
    lambda s: chat.format_preferences(s.createDataFrame([], CHAT), s.createDataFrame([], CHAT)),
    lambda s: s.createDataFrame([], "page_id long, html string").select(html.extract(html.F.col("html"))),
])
def test_empty_table(spark, run):
    assert run(spark).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="content"><article><header><h1>The&nbsp;title &amp; more</h1></header><p><b>First   part<br>goes on, with <a href="x">a link</a>.
<p>Second one, longer than the rest of them, with text &lt;b&gt; in it.</p><ul><li>An item of a list, that is long enough.<li>Another item of the list, long enough.</ul>
<div class="comments"><p>Reader says: first!</p></div></article></div><aside>More</aside><form>Search <input name=q></form>
<div class="sidebar"><p>Related things, and so on.</p></div><footer>&copy; 2024 Someone.</footer></body></html>"""


def test_html():
    assert html.main_text(PAGE).split("\n") == [
        "The title & more", "First part goes on, with a link.", "Second one, longer than the rest of them, with text <b> in it.",
        "An item of a list, that is long enough.", "Another item of the list, long enough."]
    for page in (None, "", "<", "<p", "</p></div>", "<nav>x</nav>", "<script>x", "\x00", "<div " * 50):
        assert isinstance(html.main_text(page), str)
    assert html.main_text("just text, no markup") == "just text, no markup"
    assert html.main_text("<div>" * 5000 + "deep text here." + "</div>" * 10) == "deep text here."


def test_rollups(spark, tmp_path):
    docs = "doc_id long, text string, source string, lang string"
    a = spark.createDataFrame([(1, "a b", "s", "en"), (2, None, None, "en"), (3, "x", "s", None), (3, "x", "s", None)], docs)
    ledger = rollups.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.totals().collect() == []
    assert ledger.commit("1", rollups.inserts(a, "words/1")) and not ledger.commit("1", rollups.inserts(a, "words/1"))
    key = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert key() == {("s", "en"): (1, 2), (None, "en"): (1, 0), ("s", None): (2, 2)}
    one = spark.createDataFrame([(1, "a b", "s", "en")], docs)
    ledger.commit("2", rollups.revisions(one, one.selectExpr("doc_id", "'a b c' as text", "source", "lang"), "words/1"))
    assert key()[("s", "en")] == (1, 3)
    (tmp_path / "ledger" / "data" / "3-half").mkdir()  # lost half-way: no manifest names it
    assert ledger.batches() == ["1", "2"]
    ledger.commit("3", rollups.deletes(a.where("doc_id = 3"), "words/1"))
    want = {("s", "en"): (1, 3), (None, "en"): (1, 0)}
    assert key() == want
    ledger.compact()
    assert key() == want and not ledger.commit("2", rollups.inserts(a, "words/1"))
    ledger.vacuum()
    assert key() == want and ledger.batches() == ["1", "2", "3"] and len(list((tmp_path / "ledger" / "data").iterdir())) == 1
    with pytest.raises(ValueError):
        ledger.commit("../x", a)


def test_stopped_compaction_and_rival_writers_change_no_total(spark, tmp_path, monkeypatch):
    a = spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string")
    ledger, rival = (rollups.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    for batch in ("1", "2"):
        ledger.commit(batch, rollups.inserts(a, "words/1"))
    totals = lambda: [(r["n_docs"], r["n_tokens"]) for r in rival.totals().collect()]

    def stop(*_):
        raise RuntimeError("stopped")

    for when in ("_write", "_publish"):  # before and after the sums are written
        with monkeypatch.context() as m:
            m.setattr(rollups.Ledger, when, stop)
            with pytest.raises(RuntimeError):
                ledger.compact()
        assert totals() == [(2, 4)] and not ledger.commit("1", rollups.inserts(a, "words/1"))
    publish = rollups.Ledger._publish

    def late(self, number, manifest):  # the rival commits the same batch, and another, just before
        if self is ledger and not rival.committed("3"):
            assert rival.commit("3", rollups.inserts(a, "words/1")) and rival.commit("4", rollups.inserts(a, "words/1"))
        return publish(self, number, manifest)

    monkeypatch.setattr(rollups.Ledger, "_publish", late)
    assert not ledger.commit("3", rollups.inserts(a, "words/1")) and totals() == [(4, 8)]
    ledger.compact()
    assert totals() == [(4, 8)] and rival.batches() == ["1", "2", "3", "4"]


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("docs, labels, want", [
    ([], [], []),
    ([(1, "a, b", "s", "en")], [], [("pieces/1", 1, 3), ("words/1", 1, 2)]),
    ([(1, "a, b", "s", "en")] * 2, [(1, None, 1), (1, 1, None), (None, 0, 1), (1, 1, 1)], [("pieces/1", 2, 6), ("words/1", 2, 4)]),
    ([(1, "a", "s", "en"), (None, None, "s", "en")], [(1, 1, 0), (1, 0, 0), (7, 0, 0)], [("pieces/1", 1, 0), ("words/1", 1, 0)]),
])
def test_rollup_query_over_odd_tables(spark, tmp_path, docs, labels, want):
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = rollups.op5_token_rollups(spark, str(tmp_path)).collect()
    assert sorted((r["tokenizer"], r["n_docs"], r["n_tokens"]) for r in got) == want


CHAT = "pair_id long, turn long, role string, text string, c string"


def test_chat(spark):
    c = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (3, 0, "user", "a"), (None, 0, "user", "z"), (5, 0, None, None), (5, 1, "assistant", "x")]
    r = [(1, 1, "assistant", "bad"), (1, 0, "user", "q"), (2, 0, "user", "same"), (4, 0, "user", "a"), (None, 0, "user", "z"), (5, 0, None, None)]
    frame = lambda rows: spark.createDataFrame([(*x, "k") for x in rows], CHAT)
    got = {x["pair_id"]: x for x in chat.format_preferences(frame(c), frame(r)).collect()}
    assert set(got) == {1, 2, 5}
    x = got[1]
    assert (x["n_prefix"], x["prompt"], x["chosen"], x["rejected"]) == (1, "<|user|>\nq<|end|>\n", "<|assistant|>\ngood<|end|>\n", "<|assistant|>\nbad<|end|>\n")
    assert [(s["start"], s["length"], s["trained"]) for s in x["chosen_spans"]] == [(0, 14, False), (14, 12, True)]
    assert (got[2]["n_prefix"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "") and got[2]["chosen_spans"] == []
    assert (got[5]["n_prefix"], got[5]["rejected"], got[5]["prompt"]) == (1, "", "<||>\n<|end|>\n")


def test_swapped_answers(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "bye"), (1, 0, "user", "r"), (1, 1, "assistant", None), (2, 0, "user", "x"), (3, 0, "assistant", "a3"), (None, 0, "assistant", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["pair_id"], r["turn"]): r["text"] for r in chat.last_answer_swapped(frame).collect()}
    ring = sorted((0, 1, 3), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    answer, at = {0: "a0", 1: None, 3: "a3"}, {0: 1, 1: 1, 3: 0}
    want = {(r[0], r[1]): r[3] for r in rows if r[0] is not None}
    want |= {(c, at[c]): answer[ring[(i + 1) % 3]] for i, c in enumerate(ring)}
    assert got == want
    alone = chat.last_answer_swapped(frame.where("conv_id = 0")).collect()
    assert sorted(r["text"] for r in alone) == ["a0", "bye", "q"]


def test_every_conversation_with_an_answer_finds_another(spark):
    """Whatever the ids are, here all even and far apart: rings are by hash."""
    frame = spark.range(2000).selectExpr("id * 1000000 conv_id", "0L turn", "'assistant' role", "cast(id as string) text")
    got = {r["pair_id"]: r["text"] for r in chat.last_answer_swapped(frame).collect()}
    assert len(got) == 2000 and sorted(got.values(), key=int) == [str(i) for i in range(2000)]
    assert all(k != int(v) * 1_000_000 for k, v in got.items())


def test_very_long_conversations_and_repeated_turns(spark):
    import time

    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(30_000)] + [(2, 0, "user", "x")] * 3
    c = spark.createDataFrame([(*r, "k") for r in rows], CHAT)
    r = c.where("pair_id = 2 or turn < 10").repartition(3)
    began = time.time()
    got = {x["pair_id"]: x for x in chat.format_preferences(c, r).collect()}
    assert time.time() - began < 20
    assert got[1]["n_prefix"] == 10 and got[1]["rejected"] == "" and len(got[1]["chosen_spans"]) == 2 * 29_990
    at = 0
    for s in got[1]["chosen_spans"]:
        assert s["start"] == at
        at += s["length"]
    assert at == len(got[1]["chosen"]) and got[2]["prompt"] == "<|user|>\nx<|end|>\n" * 3
