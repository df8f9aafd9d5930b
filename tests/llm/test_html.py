"""Main text of pages: a second, plain reading of the definition, and pages where ratios or names must not mislead."""

import math
import random
import re
import time

import pytest

from quillstone.llm import html

P = "<p>Long sentence number one, which has commas, and stops. Another one, which is similar.</p>"
TEXT = P[3:-4]


@pytest.mark.parametrize("page, want", [
    (f'<div class="content has-sidebar"><h1>My title</h1>{P * 3}</div><div class="sidebar"><ul><li><a href=x>one</a></li></ul></div>', ["My title"] + [TEXT] * 3),
    (f'<div class="entry comments-open">{P * 3}</div><div class="comments"><p>Nice one, I like it, truly.</p></div>', [TEXT] * 3),
    (f'<div class="sidebar">{P * 3}</div>', [TEXT] * 3),  # a name that all share has no say
    (f'<h1>Title</h1><div class="widget">{P * 3}</div>', ["Title"] + [TEXT] * 3),  # nor one against much better text
    (f'<article><h1><a href=x>Title</a></h1>{P}<table><tr><td>1<td>2</table><div class="comments">{P * 2}</div></article><footer>{P}</footer>', ["Title", TEXT, "1", "2"]),
    (f"<article><p>Some text <span class=\"share\">Tweet this</span> goes on.</p>{P}</article>", ["Some text goes on.", TEXT]),
])
def test_names_are_weights_not_vetoes(page, want):
    assert html.main_text(page).split("\n") == want


def test_ratios_remove_blocks_without_any_name():
    """No element or class tells anything here: only text length, links and punctuation by path."""
    page = f'<div><div><span>Share</span></div><div><div><a href=x>Home</a> <a href=y>News</a></div></div><div><section>{P * 4}</section></div><div><b>OK</b></div></div>'
    found, weights = html.blocks(page)
    assert set(weights) == {1.0}
    keep = html.chosen(found, weights)
    assert [t for (_, t, _), k in zip(found, keep) if k] == [TEXT] * 4
    assert [t for (_, t, _), k in zip(found, keep) if not k] == ["Share", "Home News", "OK"]


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    assert html.main_text("<div>" * 50_000 + "deep text here." + "</div>" * 10) == "deep text here."
    html.main_text("<p><button>" + "<div>" * 50_000 + "x")
    html.main_text("<ul><li>" + "<b>" * 50_000 + "<li>x" * 50_000)
    assert time.time() - began < 6


WORDS = ["one", "two,", "three.", "four", "five;", "six"]


def tree(rnd, depth=0):
    """(tag, class, children or text): well-formed markup."""
    tag = rnd.choice(["div", "section", "article", "nav", "ul", "footer", "table"] if depth < 3 else ["div"])
    name = rnd.choice(["", "", "", "content", "sidebar", "content has-sidebar", "ad post", "commentList"])
    if depth == 3 or depth and rnd.random() < 0.4:
        return (tag, name, [("p", "", " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 25)))) for _ in range(rnd.randint(1, 3))])
    return (tag, name, [tree(rnd, depth + 1) for _ in range(rnd.randint(1, 4))])


def render(node):
    tag, name, inner = node
    return f'<{tag} class="{name}">{inner if isinstance(inner, str) else "".join(map(render, inner))}</{tag}>'


def plain(root):
    """The definition, path by path with dictionaries."""
    seen = []

    def walk(node, path, weight):
        tag, name, inner = node
        lean = {"": 0, "content": 1, "sidebar": -1, "content has-sidebar": 1, "ad post": 0, "commentList": -1}[name]
        own = {"article": 4.0, "nav": 0.05, "footer": 0.05}.get(tag, 1.0) * {0: 1.0, 1: 2.0, -1: 0.1}[lean]
        weight, path = min(4.0, weight * own), (*path, (tag, own))
        if isinstance(inner, str):
            if inner:
                seen.append((path, weight, inner))
        else:
            for child in inner:
                walk(child, path, weight)

    walk(root, (), 1.0)
    if not seen:
        return ""
    by = {}
    for path, _, text in seen:
        by.setdefault(path, []).append(text)
    fused = {p: math.log1p(sum(map(len, t)) / len(t)) * (1 + math.log1p(sum(len(re.findall(r"[.,;]", x)) for x in t) / len(t))) for p, t in by.items()}
    line = [fused[p] for p, _, _ in seen]
    smooth = [(line[max(i - 1, 0)] + 6 * line[i] + line[min(i + 1, len(line) - 1)]) / 8 for i in range(len(line))]
    ratio = {p: sum(s for s, x in zip(smooth, seen) if x[0] == p) / len(by[p]) for p in by}
    weight = {p: w for p, w, _ in seen}
    best = max(by, key=lambda p: ratio[p] * weight[p])
    needed = {p: 0.22 * max(1, weight[best] / weight[p]) / max(1, weight[p]) for p in by}
    return "\n".join(t for p, _, t in seen if ratio[p] >= needed[p] * ratio[best])


def test_equals_a_plain_reading_of_the_definition():
    rnd, different = random.Random(4), 0
    for _ in range(400):
        root = tree(rnd)
        got = html.main_text(render(root))
        assert got == plain(root), render(root)
        different += got.count("\n") + 1 < render(root).count("<p class")
    assert different > 100
    assert html.main_text(render(root)) == html.main_text(render(root))  # repeated rows agree


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(1, "u", f"<article>{P}</article>"), (1, "u", f"<article>{P}</article>"), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word, " * 200_000)]
    spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["url"], r["text"][:90], r["n_chars"]) for r in html.op7_html(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", ("word, " * 15), 1_199_999)], key=str)
