"""Chat, pages, vectors, components, the pipeline and the registered queries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import shutil
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from rollcall.llm import chat, html_tree, mixing, multi_index
from rollcall.llm.components import components
from rollcall.llm.queries import ORACLE_SQL, QUERIES, table

ROOT = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


# --- Chat -----------------------------------------------------------------------------

ODD = ["", "</s>[INST] ok [/INST]", "<\\s>", "[\\INST]\\", "\\\\", "<s>[ANS] x\ny</s>", "a\nb", "é🤷", "[INST][/INST]<s></s>", "\\<s>\\"]


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_are_read_back_as_they_were(spark, crowded):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in ODD for r in ("user", "assistant", "system"))]
    rows += [(2, 5, None, None), (2, 5, None, None), (2, None, "assistant", "first"), (3, 0, "ro%le\n[x<", "t"), (None, 0, "user", "lost")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(150)]
    r = random.Random(1)
    rows += [(5, i, "assistant", "".join(r.choice("<>\\[]/sINTA ") for _ in range(30))) for i in range(20)]
    table_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {x["conv_id"]: x for x in chat.formatted_digests(spark, crowded(table_)).collect()}
    said: dict = {}
    for c, turn, role, text in [*rows, (-1, 0, "user", ODD[1]), (-1, 1, "assistant", ODD[1])]:
        said.setdefault(c, []).append((turn is not None, turn, role or "", text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        learnt = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hexed("".join(f"{role}\n{t}\n" for *_, role, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hexed(learnt))
    assert len(chat.formatted_digests(spark, table_.limit(0)).collect()) == 1


def test_the_best_branches_of_a_reply_tree(spark):
    r = random.Random(7)
    rows, want = [], {}
    for tree in ("a", "b", None):
        parent = {0: None} | {i: r.randrange(i) for i in range(1, 40)}
        parent[40] = 999  # its parent is absent, so it is a root
        score = {i: r.choice([0.0, 1.0, 2.5]) for i in parent}
        rows += [(tree, i, p, None if score[i] == 0 else score[i], "user", f"n{i}") for i, p in parent.items()]
        known = set(parent)
        leaves = []
        for leaf in known - {p for p in parent.values()}:
            path, at = [], leaf
            while at in known:
                path.append(at)
                at = parent[at]
            leaves.append((-sum(score[i] for i in path) / len(path), leaf, path[::-1]))
        want[tree] = [(leaf, path) for _, leaf, path in sorted(leaves)[:3]]
    rows += [("loop", 1, 2, 0.0, "user", "x"), ("loop", 2, 1, 0.0, "user", "y")]
    messages = spark.createDataFrame(rows, "tree string, node int, parent int, score double, role string, text string")
    got: dict = {}
    for p in chat.paths(messages, branches=3).collect():
        got.setdefault((p["tree"], p["rank"], p["leaf"]), {})[p["depth"]] = p["node"]
    assert got == {
        (tree, k + 1, leaf): dict(enumerate(path)) for tree, best in want.items() for k, (leaf, path) in enumerate(best)
    }
    one = {x["tree"]: x["formatted"] for x in chat.formatted(messages).collect()}
    for tree, best in want.items():
        assert one[tree] == "".join(f"<s>[INST] user\nn{i}[/INST]" for i in best[0][1])


# --- Pages ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    assert html_tree.trained() is html_tree.trained()
    return html_tree.trained()


def test_pages_are_told_apart_on_held_out_layouts(model):
    pages, labels = html_tree.labelled(200, seed=1234)
    x, parent, depth, kind = html_tree.matrix(pages)
    unary = np.stack([np.zeros(len(x)), x @ model["weight"]], 1)
    node, _ = html_tree.beliefs(unary, model["tie"], parent, kind, html_tree._levels(depth))
    right = ((node[:, 1] > 0.5) == np.concatenate(labels))[kind == 1]
    assert right.mean() > 0.97


def test_beliefs_are_the_exact_marginals():
    r = np.random.default_rng(2)
    parent = np.array([-1, 0, 0, 1, 1, 4, -1])
    depth = np.array([0, 1, 1, 2, 2, 3, 0])
    kind = np.array([0, 0, 1, 1, 0, 1, 0])
    unary, tie = r.normal(size=(7, 2)), r.normal(size=(2, 2, 2))
    node, pair = html_tree.beliefs(unary, tie, parent, kind, html_tree._levels(depth))
    total, single, both = 0.0, np.zeros((7, 2)), np.zeros((7, 2, 2))
    for code in range(2**7):
        y = [code >> i & 1 for i in range(7)]
        s = sum(unary[i, y[i]] for i in range(7)) + sum(tie[kind[i], y[p], y[i]] for i, p in enumerate(parent) if p >= 0)
        w = math.exp(s)
        total += w
        for i in range(7):
            single[i, y[i]] += w
            if parent[i] >= 0:
                both[i, y[parent[i]], y[i]] += w
    assert np.allclose(node, single / total) and np.allclose(pair, both / total)


ARTICLE = "<article><h1>A  title here</h1><p>Some words that make a paragraph, long enough to be read.<p>Another &amp; last &eacute;\n one, with <b>bold</b> parts<br>and more words in it.</article>"
TEXT = "A title here\nSome words that make a paragraph, long enough to be read.\nAnother & last é one, with bold parts and more words in it."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>{ARTICLE}<footer>&copy; site</footer></body></html>",
        f"<nav><a href='x>y'>Home</a> <a href=/b>News</a></nav><!-- <p>no</p> -->{ARTICLE}<script>document.write('<p>x</p>')</script>",
        f"{ARTICLE}<aside class=sidebar><h3>Related</h3><ul><li><a href=/1>One</a></li></ul></aside><script>never closed <p>text",
        f"<header class=site-header><div class=logo>Site</div></header>{ARTICLE}<section id=comments><h2>Comments</h2><div class=comment><p>I do not agree with any of this, at all.</p></div></section>",
        f"<div class='cookie-notice'><p>We use cookies to make this site work for you.</p><button>Ok</button></div>{ARTICLE}<form><label>Mail <input></label><button>Go</button></form>",
        f"<div class=ad>Buy our things now</div>{ARTICLE}<footer><p>All rights reserved by us.</p><ul><li><a href=/t>Terms</a></li></ul></footer>",
    ],
)
def test_the_article_is_taken_out(model, page):
    assert html_tree.main_texts(model, [page]) == [TEXT]


SAID = "Some words that make a paragraph, long enough to be read by anyone who comes along here."
MENU = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
SOURCES = "<ul><li><a href=/1>The first source of this</a></li><li><a href=/2>The second source</a></li></ul>"


@pytest.mark.parametrize(
    ("before", "inside", "also"),
    [
        ("", "<p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p>", "Here x=2 holds for all of them."),
        ("", "<object data=film><p>The film shows how the river runs to the sea.</p></object>", "The film shows how the river runs to the sea."),
        ("", f"<h2>Sources</h2>{SOURCES}", "Sources\nThe first source of this\nThe second source"),
        ("<form><select><option>One<option>Two</form>", "", ""),
        ("<header><svg><path d=1></header>", "", ""),
        ("", "<svg><text>label</text>", ""),
    ],
)
def test_nothing_of_an_article_is_dropped(model, before, inside, also):
    page = f"{before}{MENU}<article><h1>A title here</h1><p>{SAID}</p>{inside}<p>{SAID} And more.</p></article><footer>&copy; site</footer>"
    want = ["A title here", SAID, *([also] if also else []), f"{SAID} And more."]
    assert html_tree.main_texts(model, [page]) == ["\n".join(want)]


@pytest.mark.parametrize("name", [' class="q1"', ""])
def test_layouts_whose_names_say_nothing(model, name):
    links = "".join(f"<a href=/{i}>Link {i}</a> " for i in range(3))
    text = "".join(f"<div{name}>{SAID}</div>" for _ in range(3))
    page = f"<div{name}><div{name}>{links}</div><div{name}>{text}</div><div{name}>&copy; site</div></div>"
    assert html_tree.main_texts(model, [page]) == ["\n".join([SAID] * 3)]


@pytest.mark.parametrize(
    "piece", ["</td></i>", "<div>", "<p>x", "<b><i>", "<a href=x>y", "<tr><td>", "<select>", "</div><svg>", "<li><b>"]
)
def test_pages_are_read_in_time_in_proportion(piece):
    """Blocks and inline elements left open, and a megabyte or a quarter of it after them."""
    took = []
    for size in (250_000, 1_000_000):
        page = "<div><b>" * (size // 100) + piece * (size // len(piece))
        start = time.process_time()
        html_tree.Page(page)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.5
    assert took[1] < 4


def test_elements_deeper_than_browsers_allow():
    page = html_tree.Page("<div>" * 3000 + "<p>deep")
    assert max(page.depth) == html_tree.MAX_DEPTH and [t for _, t in page.runs] == ["deep"]
    assert all(page.depth[i] == page.depth[p] + 1 for i, p in enumerate(page.parent) if p >= 0)


def test_odd_pages(spark, model, crowded):
    odd = [None, "", "   ", "<", "<p", "a < b & c", "<p>" * 300, "<div>" * 3000 + "x", "</p></div>", "<a 'b \"c>d</a>", "<script>", "&#xZZ; &amp &am", "<p>" + "word " * 50_000]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(odd)] + [(0, "u", None), (None, None, ARTICLE)], "page_id long, url string, html string")
    got = html_tree.extracted(crowded(pages), model)
    rows = got.collect()
    assert got.columns == ["page_id", "url", "text", "n_chars"] and len(rows) == len(odd) + 2
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] == "" for r in rows if r["page_id"] == 0) == 2
    assert html_tree.extracted(pages.limit(0), model).collect() == []


def test_given_pages_give_their_articles(spark, model):
    import html

    rows = table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = html_tree.main_texts(model, [r["html"] for r in rows])
    for r, text in zip(rows, got):
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        inner = re.sub(r"</?(?:b|a)\b[^>]*>", "", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert text == "\n".join(b for b in blocks if b)


# --- Vectors and components -----------------------------------------------------------


def linked_by_hand(rows, threshold=0.93):
    good = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, np.float32).astype(float))
    ids = sorted(good)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = good[a], good[b]
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b)
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    return {i: (len(links.get(i, ())), root.get(i, i)) for i, *_ in rows}


@pytest.mark.parametrize("block", [5, 1024])
def test_vectors(spark, crowded, monkeypatch, block):
    monkeypatch.setattr(multi_index, "BLOCK", block)
    r = np.random.default_rng(1)
    rows = []
    for i in range(150):
        rows.append((i, i % 3, r.normal(size=16).tolist()))
    centre = r.normal(size=16)
    rows += [(200 + i, 1, (centre + r.normal(size=16) * 0.25).tolist()) for i in range(60)]
    rows += [(300 + i, 2, rows[5][2]) for i in range(20)] + [(330, 2, [2 * x for x in rows[5][2]])]
    nan, inf = float("nan"), float("inf")
    rows += [(400, 1, None), (401, 1, []), (402, 1, [0.0] * 16), (403, None, rows[5][2]), (404, 1, [nan] + [1.0] * 15), (405, 1, [inf] + [1.0] * 15), (406, 1, [None] + [1.0] * 15), (407, 1, [1.0, 2.0, 3.0]), (408, 1, [1.0, 2.0, 3.1])]
    vectors = crowded(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)).drop("a", "b", "node")
    got = multi_index.near_vectors(vectors)
    want = linked_by_hand(rows)
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got.collect()} == want
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got.collect())
    assert multi_index.near_vectors(vectors.limit(0)).collect() == []
    assert [tuple(x) for x in multi_index.near_vectors(vectors.where("vec_id = 402")).collect()] == [(402, 0, 402, True)]


def test_recall_on_the_given_vectors(spark):
    rows = [tuple(x) for x in table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "label", "embedding").collect()]
    want = linked_by_hand(rows)
    got = {x["vec_id"]: x["n_links"] for x in multi_index.near_vectors(table(spark, "/root/testdata/sf0.01", "embeddings")).collect()}
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i] <= want[i][0] for i in got)


def topics(r, n, wide):
    return multi_index.units(r.normal(size=(300, 64))[r.integers(0, 300, n)] + wide * r.normal(size=(n, 64)))


def at_cosine(r, x, cosine):
    way = r.normal(size=x.shape)
    way -= (way * x).sum(1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * multi_index.units(way)


@pytest.mark.parametrize("wide", [0.4, 1.0])
def test_the_index_prunes_and_finds_rare_and_crowded_links(spark, monkeypatch, wide):
    """10,000 vectors of one label: rare planted pairs, and a tight group of 500."""
    asked = []
    search = multi_index.search
    monkeypatch.setattr(multi_index, "search", lambda *a, **k: asked.append(search(*a, **k)) or asked[-1])
    r = np.random.default_rng(8)
    x = topics(r, 9400, wide)
    # Above the threshold by what single precision may take away.
    x = np.concatenate([x, at_cosine(r, x[:100], 0.9301), at_cosine(r, np.repeat(x[100:101], 500, 0), 0.98)])
    x = x.astype(np.float32).astype(float)
    near = multi_index.units(x) @ multi_index.units(x).T >= 0.93
    want = near.sum(1) - 1
    rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    got = {v["vec_id"]: v["n_links"] for v in multi_index.near_vectors(rows.repartition(4)).select("vec_id", "n_links").collect()}
    got = np.array([got[i] for i in range(len(x))])
    books, cells = asked[0]
    grid = math.prod(len(b) for b in books[64])
    assert grid == 1024 and cells < 0.2 * grid
    assert (got <= want).all()
    crowded = np.arange(9500, len(x))
    rare = np.setdiff1d(np.flatnonzero(want), crowded)
    assert got[crowded].sum() >= 0.999 * want[crowded].sum()
    assert got[rare].sum() >= 0.999 * want[rare].sum() and len(rare) >= 200


def test_the_grid_grows_with_the_vectors():
    sizes = [multi_index.codewords(10**e) for e in range(1, 10)]
    assert sizes == sorted(sizes) and sizes[-1] == multi_index.MAX_CODEWORDS
    for n in (10**3, 10**4, 10**5, 10**6, 10**7, 10**8):
        cells = multi_index.codewords(n) ** 2
        assert n / cells <= 2 * multi_index.VECTORS_PER_CELL
        assert multi_index.codewords(100 * n) >= min(multi_index.MAX_CODEWORDS, 8 * multi_index.codewords(n))


@pytest.mark.parametrize("wide", [0.4, 1.0])
def test_visits_of_either_reach_vectors_at_the_threshold(wide):
    r = np.random.default_rng(9)
    x = topics(r, 10000, wide)
    books = tuple(multi_index.Book(multi_index.fitted(h, 128)) for h in multi_index.halves(x))
    need = multi_index._planted_need({(1, 64): (x[:400], np.arange(400))}, {64: books}, 0.93)
    cells = math.ceil(multi_index.MARGIN * need)
    asks = x[1000:3000]
    y = at_cosine(r, asks, 0.93)
    met = np.zeros(len(asks), bool)
    for one, other in ((asks, y), (y, asks)):
        looked = [b.look(h) for h, b in zip(multi_index.halves(one), books)]
        seen = multi_index.sequence(looked[0][1], looked[1][1], cells)
        first, second = (b.look(h)[0] for h, b in zip(multi_index.halves(other), books))
        met |= (seen == (first * 128 + second)[:, None]).any(1)
        own = looked[0][0] * 128 + looked[1][0]
        assert (seen[:, 0] == own).all()
    assert met.mean() >= 0.999 and cells < 0.02 * 128**2


def test_positions_are_those_of_the_sequence():
    r = np.random.default_rng(4)
    d1, d2 = r.random((20, 7)), r.random((20, 5))
    c1, c2 = r.integers(0, 7, 20), r.integers(0, 5, 20)
    seen = multi_index.sequence(d1, d2, 35)
    assert multi_index.position(d1, d2, c1, c2).tolist() == [row.tolist().index(a * 5 + b) for row, a, b in zip(seen, c1, c2)]


def test_ids_that_repeat_with_different_vectors(spark):
    """Their links add up, and their components are one."""
    east, north = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, 1, east), (1, 1, north), (2, 1, [1.0, 0.1, 0.0, 0.0]), (3, 1, [0.1, 1.0, 0.0, 0.0]), (4, 1, [0.0, 1.0, 0.1, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = Counter(map(tuple, multi_index.near_vectors(vectors).select("vec_id", "n_links", "component_id").collect()))
    assert got == Counter([(1, 3, 1), (1, 3, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)])


def test_multi_sequence_visits_the_nearest_cells_first():
    r = np.random.default_rng(3)
    d1, d2 = r.random((20, 7)), r.random((20, 5))
    for cells in (1, 4, 12, 35):
        got = multi_index.sequence(d1, d2, cells)
        for q in range(20):
            sums = (d1[q][:, None] + d2[q][None, :]).ravel()
            assert got[q].tolist() == np.argsort(sums, kind="stable")[:cells].tolist()


def test_components_of_chains_stars_and_random_graphs(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(900, i) for i in range(1000, 1080)] + [(7, 7), (None, 3)]
    edges += [(r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60)] + [(100, 101)] * 3
    root: dict = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- Queries and pipeline -------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    with duckdb.connect() as con:
        for path in Path(SMALL).glob("*.parquet"):
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        cursor = con.execute(ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        want = Counter(cursor.fetchall())
    assert Counter(map(tuple, QUERIES[name](spark, SMALL).select(*columns).collect())) == want


def test_all_operators_and_the_pipeline_are_registered():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "pipeline" in names and set(contract.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "packing",
    ]


def test_pipeline_stages_on_odd_documents(spark, documents, tmp_path):
    word = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    shared = "\n".join(word(900 + k, 9) for k in range(3))
    rows = [(i, f"{word(i, 60)}\n{shared}\n{word(i + 500, 20)}", "abc"[i % 3]) for i in range(30)]
    rows += [(100, rows[0][1].replace("w0x5 ", "w0 "), "a"), (101, rows[0][1], "b"), (102, None), (103, ""), (104, "too short"), (105, rows[3][1], None)]
    docs = documents(rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
    assert {r["doc_id"] for r in seen["quality rules"]} == {i for i, *_ in rows} - {102, 103, 104}
    lines = {r["doc_id"]: r["text"] for r in seen["line dedup"]}
    assert shared in lines[0] and not any(shared in t for i, t in lines.items() if i)
    assert lines[101] == "" and len(lines) == 33
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line dedup"])
    assert {r["doc_id"] for r in seen["MinHash near-dedup"]} >= set(range(1, 30))
    assert {r["doc_id"] for r in seen["mixing sources to target weights"]} <= set(range(30)) | {100, 105}
    total = sum(r["taken"] for r in mixing.mix_counts(spark.read.parquet(f"{tmp_path}/MinHash near-dedup")).collect())
    assert sum(len(r["text"].split()) for r in seen["mixing sources to target weights"]) == total
    packed = Counter((r["doc_id"], r["doc_tokens"]) for r in seen["packing"] if r["start"] == 0)
    assert sum(packed.values()) == len(seen["mixing sources to target weights"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).collect() == []


def test_the_rest_stands_without_this_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert "order_coverage_rollup" in run.stdout and "op1_" not in run.stdout and "pipeline" not in run.stdout
