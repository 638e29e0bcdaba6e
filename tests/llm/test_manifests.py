"""Fill-in-the-middle, Merkle manifest and decontamination against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import decontamination, fill_middle, merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Fill-in-the-middle ---------------------------------------------------------------


def moved(doc_id, text):
    """Form, units, prefix and middle, and output of one document."""
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    a, b, plain, spm = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or plain % 100 >= 90:
        return len(units), "plain", None, None, text
    if spm % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def marked():
    """Texts of letters, halves of marks, marks, and characters of every width."""
    r = random.Random(1)
    parts = ["ab", "é", " ", "<", "P>", "S>", "<S", "Z", "\n", "🤷", "\x00", "M>"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(300)]
    rows += [(None, None), (None, None), (None, "x y"), (7, "q"), (7, "q"), (7, "r s t"), (800, "")]
    return rows + [(900, "a" * 300_000), (901, "word é " * 40_000), (902, "🤷" * 50_000), (903, "<" * 150_001), (904, "<P" * 9)]


@pytest.mark.parametrize("piece", [None, 7])
def test_outputs_and_what_is_read_back(documents, crowded, marked, monkeypatch, piece):
    rows = marked
    if piece:
        monkeypatch.setattr(fill_middle, "PIECE_BYTES", piece)
        rows = [(i, t) for i, t in rows if len(t or "") < 1000]
    table = crowded(documents(rows))
    want = [(i, *moved(i, t), t or "") for i, t in rows]
    got = fill_middle.round_trip(table).collect()
    assert Counter(map(tuple, got)) == Counter((*w[:5], sha(w[5]), sha(w[6])) for w in want)
    texts = fill_middle.transformed(table).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "text").collect()
    assert Counter(map(tuple, texts)) == Counter(w[:6] for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_outputs_of_an_empty_table(documents):
    empty = documents([(1, "x")]).limit(0)
    assert fill_middle.round_trip(empty).collect() == []
    assert fill_middle.transformed(empty).collect() == []


def test_units_and_pieces():
    r = random.Random(2)
    text = "".join(r.choice("abZ é<🤷\n") for _ in range(5000))
    data = np.frombuffer(text.encode(), np.uint8)
    starts = fill_middle.unit_starts(data, np.array([0, len(data)]))
    assert len(starts) == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
    pieces = list(fill_middle._cut(starts, data, 0, len(data)))
    assert b"".join(pieces) == text.encode()


def test_equal_rows_stream_as_one_document(documents):
    """A third of all rows are one and the same: its pieces are sent once a batch."""
    rows = [(5, "same old text " * 9)] * 4000 + [(i, f"other {i}") for i in range(4000)]
    table = documents(rows)
    assert fill_middle.output_pieces(table).count() < 4000 * 3 + 200
    got = fill_middle.round_trip(table).where("doc_id = 5").groupBy("output_sha256", "restored_sha256").count().collect()
    assert sorted(r["count"] for r in got) == [1, 4000]


# --- Merkle manifest ------------------------------------------------------------------


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def manifest(rows, fanout):
    """Leaf, subroot, root and proof of rows (doc_id, source, lang, n_chars, text)."""
    path, subroot, heads = defaultdict(list), {}, []

    def root_of(nodes):
        while len(nodes) > 1:
            level = []
            for i in range(0, len(nodes), fanout):
                run = nodes[i : i + fanout]
                for j, (_, rows_below) in enumerate(run):
                    for row in rows_below:
                        path[row].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
                level.append((sha(*(d for d, _ in run)), [row for _, below in run for row in below]))
            nodes = level
        return nodes[0]

    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[row[2]].append((row[0] is not None, row[0] or 0, sha(*map(encoded, row)), i))
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        heads.append(root_of([(leaf, [i]) for _, _, leaf, i in sorted(groups[lang])]))
        subroot.update((i, heads[-1][0]) for i in heads[-1][1])
    root = root_of(heads)[0]
    return [(sha(*map(encoded, row)), subroot[i], root, path[i]) for i, row in enumerate(rows)]


def odd_manifest_rows(n, langs, seed=3):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", None]), r.choice(langs), i if i % 3 else None, f"t{i}") for i in range(n)]
    rows += [(None, None, langs[0], None, None)] * 3 + [(5, "s", langs[0], 2, "x")] * 2 + [(5, "s", langs[0], 2, "y")]
    return rows + [(-1, "s", langs[-1], 2**63 - 1, "long " * 50_000), (-2, "", "", 0, "")]


def manifest_table(spark, rows):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize(
    ("n", "langs", "fanout", "bucket"),
    [(60, ["en", "fr", None, "é"], 2, 1024), (150, ["en"] * 5 + [None, "é", "b", "B"], 2, 4), (60, ["en"], 3, 9), (40, [f"l{i}" for i in range(30)], 2, 2)],
)
def test_leaves_roots_and_proofs(spark, crowded, n, langs, fanout, bucket):
    rows = odd_manifest_rows(n, langs)
    table = crowded(manifest_table(spark, rows))
    out = merkle.manifest(table, fanout=fanout, bucket=bucket)
    got = Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple(zip(r["lefts"], r["rights"]))) for r in out.collect())
    want = Counter((row[0], *m[:3], tuple(m[3])) for row, m in zip(rows, manifest(rows, fanout)))
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_trees_that_are_just_full(spark, n):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(n)]
    got = merkle.manifest(manifest_table(spark, rows), bucket=4).collect()
    want = manifest(rows, 2)
    assert {(r["doc_id"], r["subroot"], tuple(zip(r["lefts"], r["rights"]))) for r in got} == {
        (i, m[1], tuple(m[3])) for i, m in enumerate(want)
    }


def test_tampering_shows(spark):
    rows = odd_manifest_rows(120, ["en", None, "fr"])
    want = Counter()
    for row, (leaf, subroot, root, path) in zip(rows, manifest(rows, 2)):
        struck = row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
        node = sha(*map(encoded, (*row[:3], row[3] + 1, row[4]))) if struck else leaf
        for left, right in path:
            node = sha(left, node, right)
        assert (node == root) != struck
        want[row[0], leaf, subroot, root, sha(*(d for step in path for d in step)), node, not struck] += 1
    assert Counter(map(tuple, merkle.manifest_report(manifest_table(spark, rows)).collect())) == want


def test_manifest_of_an_empty_table(spark):
    out = merkle.manifest_report(manifest_table(spark, [(1, "s", "en", 1, "x")]).limit(0))
    assert out.collect() == []
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_ranks_of_groups_that_lie_on_many_tasks(spark):
    rows = [(r % 3 or None, i, 1 + i % 4) for i, r in enumerate(random.Random(4).choices(range(30), k=2000))]
    table = spark.createDataFrame(rows, "grp long, key long, copies long").repartition(5)
    got = merkle.ranked(table, "grp", ["key"]).collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r["grp"]].append((r["rank"], r["key"], r["n"]))
    assert len(got) == sum(c for _, _, c in rows)
    for group, ranks in by_group.items():
        ranks.sort()
        assert [r for r, _, _ in ranks] == list(range(len(ranks)))
        assert [k for _, k, _ in ranks] == sorted(k for g, k, c in rows if g == group for _ in range(c))
        assert {n for _, _, n in ranks} == {len(ranks)}


# --- Benchmark decontamination --------------------------------------------------------


def bench_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def hits(docs, items, width=10):
    """For each document its words, the places hit, and the items."""
    windows = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        size = min(width, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(item)
    for doc_id, text in docs:
        words, places, of = bench_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    places.update(range(i, i + size))
                    of |= windows[tuple(words[i : i + size])]
        yield doc_id, text, words, places, of


@pytest.fixture(scope="module")
def benchmark_rows():
    r = random.Random(6)
    vocabulary = ["Alpha", "béta", "GAMMA", "delta", "É", "é", "x1", "🤷", "İ", "K", "ß", "Σας", "word"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, r.choice([" ", ", ", "-"]).join(say(r.choice([12, 15, 30])))) for i in range(12)]
    items += [(20, "Zed 5 yes"), (21, "only"), (22, "!?"), (23, None), (24, ""), (None, "no id here"), (20, "second text of twenty")]
    items += [(30, items[0][1]), (31, items[0][1].upper()), (9, "one two three four five six seven eight nine ten")]
    docs = []
    for i in range(150):
        words = say(r.randint(0, 40))
        if i % 3 == 0:
            item = (r.choice(items)[1] or "").split()
            words[3:3] = item[: r.choice([5, 11, 40])]
        docs.append((i, r.choice([" ", ". ", "\x00", "\n"]).join(words) + r.choice(["", ".\n", "\x7f"])))
    docs += [(None, None), (None, ""), (None, "zed 5 YES"), (5, "ONLY only"), (5, "ONLY only"), (6, "zed5yes"), (7, "ZED--5!yes;")]
    return docs + [(200, "filler words " * 30_000 + items[0][1] + " end")], items


@pytest.mark.parametrize("set_bytes", [decontamination.SET_BYTES, 4000])
def test_hits_are_those_of_a_plain_search(spark, documents, crowded, benchmark_rows, set_bytes):
    docs, items = benchmark_rows
    bench = crowded(spark.createDataFrame(items, "item_id long, text string").repartition(2))
    got = decontamination.contamination(crowded(documents(docs)), bench, set_bytes=set_bytes)
    want = Counter()
    for doc_id, _, words, places, of in hits(docs, items):
        ids = ",".join(sorted("" if i is None else str(i) for i in of))
        want[doc_id, len(words), len(places), len(of), sha(ids), bool(places)] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert sum(w[5] for w in want) > 30


def test_spans_and_documents_are_removed(spark, documents, crowded, benchmark_rows):
    docs, items = benchmark_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = crowded(documents(docs))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    want, clean = Counter(), Counter()
    for doc_id, text, words, places, _ in hits(docs, items):
        if not places:
            want[doc_id, text] += 1
            clean[doc_id, text] += 1
            continue
        ends = [m.end() for m in re.finditer(word, text)]
        assert len(ends) == len(words)
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        want[doc_id, "".join(p for i, p in enumerate(parts) if i not in places) + text[ends[-1] :]] += 1
    spans = decontamination.decontaminated(table, bench)
    assert spans.columns == table.columns
    assert Counter((r["doc_id"], r["text"]) for r in spans.collect()) == want
    whole = decontamination.decontaminated(table, bench, remove="documents")
    assert Counter((r["doc_id"], r["text"]) for r in whole.collect()) == clean
    with pytest.raises(ValueError):
        decontamination.decontaminated(table, bench, remove="words")


def test_empty_tables_and_items_without_words(spark, documents):
    docs, none = documents([(1, "a b c"), (2, None)]), spark.createDataFrame([], "item_id long, text string")
    for items in (none, spark.createDataFrame([(1, "!"), (2, None)], "item_id long, text string")):
        got = decontamination.contamination(docs, items).select("doc_id", "n_words", "n_hit", "contaminated")
        assert Counter(map(tuple, got.collect())) == Counter([(1, 3, 0, False), (2, 0, 0, False)])
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), some).collect() == []


def test_decontamination_needs_no_python_and_one_scan(spark, documents):
    """Windows are looked up where documents are read, by their code alone."""
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    plan = decontamination.contamination(documents([(1, "a")]), items)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "Python" not in physical and "Arrow" not in physical and "Pandas" not in physical
    assert physical.count("BroadcastHashJoin") == 1 and "Cartesian" not in physical and "NestedLoop" not in physical
    assert re.search(r"BroadcastHashJoin \[code#\d+L\], \[set_code#\d+L\]", physical)
