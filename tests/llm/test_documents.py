"""Operators on documents against plain Python, on small tables with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rollcall.llm import mixing, packing, probminhash, quality, suffix_family, token_prefix, words
from rollcall.llm.line_windows import without_repeated_windows
from rollcall.llm.queries import table, tokenizer_path

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, low=2, high=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeionrst") for _ in range(r.randint(low, high))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    long = prose(1, 3000)
    return [None, "", " \n\t ", "one", "é ü 🤷 ﬁ́", prose(2, 60), prose(2, 60), long, long[:9000] + "x" + long[9000:], "a\x00b <|endoftext|> </s> 's it's",
            "\n".join(prose(i, 8) for i in range(9)), "word " * 400]


# --- Token counts ---------------------------------------------------------------------


def test_token_counts_are_the_librarys(documents, crowded, odd_texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    rows = list(enumerate(odd_texts)) + [(3, "one"), (None, "x")]
    got = token_prefix.token_counts(crowded(documents(rows)), tokenizer_path(PIECE_BPE)).collect()
    want = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    empty = documents([(1, "x")]).limit(0)
    assert token_prefix.token_counts(empty, tokenizer_path(PIECE_BPE)).collect() == []


def test_prefix_counts_are_exact_at_every_character():
    import pyarrow as pa
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE))
    prefixes = token_prefix.PrefixCounts(tokenizer_path(PIECE_BPE))
    r = random.Random(5)
    letters = list("aabcdeth  \n\t▁Áñé'<|>/s12.!\x00 ﬁ̈😀Σσ") + ["<s>", "the", " of", "tion", ", "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    (_, tokens, _), *more = prefixes.rows(pa.array(texts), 10**9)
    assert not more
    assert tokens.tolist() == [len(model.encode(t)) for t in texts]
    for text in texts[:150]:
        for limit in (3, 9):
            _, _, fitting = next(prefixes.rows(pa.array([text]), limit))
            assert fitting[0] == max(k for k in range(len(text) + 1) if len(model.encode(text[:k])) <= limit)


def test_memory_stays_bounded_over_distinct_strings():
    """Long strings that never come again, and few limits: everything is forgotten in time."""
    import pyarrow as pa

    prefixes = token_prefix.PrefixCounts(tokenizer_path(PIECE_BPE))
    prefixes.counts._limit = 2 << 20
    r = random.Random(7)
    most, resets = 0, 0
    for _ in range(25):
        lines = ["".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(400)) for _ in range(60)]
        before = prefixes.counts.n_bytes
        (_, tokens, _), *_ = prefixes.rows(pa.array(lines), 10**9)
        assert tokens.tolist() == [len(prefixes._model.encode(t)) for t in lines]
        most, resets = max(most, prefixes.counts.n_bytes), resets + (prefixes.counts.n_bytes < before)
    assert resets >= 1 and most < 6 << 20


def test_verdicts_on_pairs_are_forgotten(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_prefix, "APART_LIMIT", 50)
    prefixes = token_prefix.PrefixCounts(tokenizer_path(PIECE_BPE))
    for i in range(8):
        text = prose(i, 200)
        (_, tokens, _), *_ = prefixes.rows(pa.array([text]), 10**9)
        assert tokens.tolist() == [len(prefixes._model.encode(text))]
    list(prefixes.rows(pa.array(["a"]), 9))
    assert sum(map(len, prefixes._apart.values())) < 50


# --- Packing --------------------------------------------------------------------------


@pytest.mark.parametrize("group_bytes", [500, 1 << 22])
def test_packing_holds_every_id_once(documents, crowded, odd_texts, monkeypatch, group_bytes):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_BYTES", group_bytes)
    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    rows = list(enumerate(odd_texts)) + [(100 + i, prose(i, 30 * i)) for i in range(40)]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    got = packing.pack(crowded(documents(rows)), tokenizer_path(WORD_BPE)).collect()
    pieces: dict = {}
    sequences: dict = {}
    for p in got:
        pieces.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
        assert p["doc_tokens"] == len(ids[p["doc_id"]])
        held = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert p["ids_crc32"] == zlib.crc32(held.tobytes())
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at
            at += p["length"]
        assert at == len(ids[i])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 2048 and all(p["sequence_tokens"] == at for p in own)
        assert {p["padding"] for p in own} == {0 if at & (at - 1) == 0 else 2048 - at}
        padding += own[0]["padding"]
        total += at
    if group_bytes > 1000:
        assert padding < 2048


def test_very_many_empty_texts_go_into_several_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 1 << 18)
    docs = spark.range(0, 30_000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack(docs, tokenizer_path(WORD_BPE))
    groups = got.groupBy((F.shiftright("sequence_id", 32)).alias("g")).count().collect()
    assert len(groups) == 8 and max(r["count"] for r in groups) < 2 * 30_000 / 8
    assert got.agg(F.sum("length")).first()[0] == 30_000


def test_packing_cuts_text_into_words_in_bounded_memory(monkeypatch):
    tokens = packing.word_tokens(tokenizer_path(WORD_BPE))
    column = pa.array(["A walk in the park, isn't it? Yes <|x|> it is. " * 400] * 200)
    given_back = []
    pool = pa.default_memory_pool()
    monkeypatch.setattr(packing.pa, "default_memory_pool", lambda: given_back.append(1) or pool)
    once = next(packing.token_rows(column, tokens, 1))
    tracemalloc.start()
    try:
        n = sum(len(ids) for ids in packing.token_rows(column, tokens, 1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 200 * len(once)
    assert peak < 24 << 20
    assert len(given_back) > 1


def interned(strings, store):
    data = np.frombuffer(b"".join(strings), np.uint8)
    codes = store(data, np.cumsum([0, *map(len, strings)]))
    return [store.flat[store.first[c] :][: store.size[c]].tolist() for c in codes]


def test_kept_words_take_little_memory_and_keep_their_values():
    made = []
    store = words.Interned(lambda keys: made.extend(keys) or [list(k[:2]) for k in keys], np.uint32)
    tracemalloc.start()
    try:
        for first in range(0, 100_000, 10_000):
            interned([b"w%07d" % i for i in range(first, first + 10_000)], store)
            made.clear()
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    # Arrays grow by doubling, so some of this is not used yet.
    assert held < 100_000 * 120
    some = [b"w0000003", b"", b"new", b"w0099999", b"new", b"w", b"w0000003"]
    assert interned(some, store) == [list(k[:2]) for k in some]
    assert sorted(made) == [b"", b"new", b"w"]


def test_kept_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "mix", lambda x: x % np.uint64(2))
    store = words.Interned(lambda keys: [list(k) for k in keys], np.uint32)
    r = random.Random(3)
    for _ in range(20):
        some = [bytes(r.choices(b"abc", k=r.randint(0, 4))) for _ in range(30)]
        assert interned(some, store) == [list(k) for k in some]
    store._limit = 0
    assert interned([b"ab", b"ba"], store) == [[97, 98], [98, 97]] and len(store._hash) == 2


def test_what_arrow_holds_unused_is_given_back_after_every_batch(monkeypatch):
    released = []
    pool = type("Pool", (), {"release_unused": lambda self: released.append(1)})()
    monkeypatch.setattr(words.pa, "default_memory_pool", lambda: pool)
    seen = [(batch, len(released)) for batch in words.one_by_one(iter("abc"))]
    assert seen == [("a", 0), ("b", 1), ("c", 2)] and len(released) == 3


def test_packing_of_repeated_rows_and_empty_tables(documents):
    twice = documents([(1, "a b c"), (1, "a b c"), (None, "d")])
    got = packing.pack(twice, tokenizer_path(WORD_BPE)).collect()
    assert sorted((p["doc_id"] or 0, p["length"]) for p in got) == [(0, 2), (1, 4), (1, 4)]
    assert packing.pack(twice.limit(0), tokenizer_path(WORD_BPE)).collect() == []


def test_pieces_go_to_the_cheapest_sequence_with_room():
    placed = packing.balanced([6, 5, 4, 3, 2], 10)
    assert [(i, to) for i, _, _, to, _ in placed[:4]] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert sum(part for *_, part, _, _ in placed) == 20
    assert packing.balanced([], 10) == [] and packing.balanced([10], 10) == [(0, 0, 10, 0, 0)]


# --- Mixing ---------------------------------------------------------------------------


def targets_by_hand(sizes):
    goal, left, free = {}, float(sum(sizes)), set(range(len(sizes)))
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    while free:
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return goal | share
        for i in over:
            goal[i] = 3.0 * sizes[i]
            left -= goal[i]
        free -= over
    return goal


def test_mixing_comes_near_its_targets(documents, crowded):
    r = random.Random(3)
    rows = [(i, prose(i, r.randint(0, 80)), r.choice(["b", "b", "b", "a", "é", "Z", None])) for i in range(600)]
    rows += [(1000, None, "n"), (1001, "", "n"), (1002, prose(9, 6000), "b"), (1003, "few words", "c")]
    docs = crowded(documents(rows)).drop("size")
    got = mixing.mix_counts(docs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_counts(docs.repartition(7)).collect()))
    words = {i: len(_WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    sizes = [sum(words[i] for i in words if source[i] == s) for s in names]
    goal = targets_by_hand(sizes)
    taken = Counter()
    for r_ in got:
        i, at = r_["doc_id"], names.index(source[r_["doc_id"]])
        assert r_["size"] == words[i] and r_["source_size"] == sizes[at]
        assert r_["target"] == pytest.approx(goal[at], rel=1e-9, abs=1e-9)
        assert 0 <= r_["taken"] <= 3 * words[i]
        taken[at] += r_["taken"]
    assert len(got) == len(rows)
    for at in range(len(names)):
        assert taken[at] == round(goal[at])


def mix_by_hand(spark, rows, block):
    """Words taken of each row (id, text, source), from the permuted blocks one by one."""
    import xxhash

    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    # Null has the seed for a hash.
    hashed = [42 if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42) for i, *_ in rows]
    hashed = [h - 2**64 if h >= 2**63 else h for h in hashed]
    size = [len(_WORD.findall(t or "")) for _, t, _ in rows]
    goal = targets_by_hand([sum(n for n, r in zip(size, rows) if r[2] == s) for s in names])
    taken = [0] * len(rows)
    for number, name in enumerate(names):
        mine = [k for k, r in enumerate(rows) if r[2] == name]
        buckets = -(-len(mine) // mixing.ROWS_PER_BUCKET)
        mine.sort(key=lambda k: (hashed[k] % buckets, hashed[k], rows[k][0] is not None, rows[k][0] or 0, size[k]))
        stream = [k for k in mine for _ in range(size[k])]
        blocks = [stream[i : i + block] for i in range(0, len(stream), block)]
        left, turn = round(goal[number]), 0
        while left:
            for at in mixing.permuted(np.arange(len(blocks)), len(blocks), mixing.permutation_key(number, turn)):
                for k in blocks[at][:left]:
                    taken[k] += 1
                left -= min(left, len(blocks[at]))
            turn += 1
    return Counter((rows[k][0], size[k], taken[k]) for k in range(len(rows)))


@pytest.mark.parametrize("block", [1, 7, 256])
def test_every_documents_share_of_the_mix(spark, documents, crowded, monkeypatch, block):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    r = random.Random(4)
    rows = [(r.choice([i, i, None]), prose(i, r.choice([0, 3, 30, 300])), r.choice(["b", "b", "b", "a", "é", None])) for i in range(260)]
    rows += [(7, "one two three", "a"), (7, "one two three", "a"), (7, "four", "a"), (900, None, "n"), (901, "lonely words", "c"), (902, prose(9, 4000), "b")]
    docs = crowded(documents(rows)).drop("size")
    got = Counter((x["doc_id"], x["size"], x["taken"]) for x in mixing.mix_counts(docs, block_words=block).collect())
    assert got == mix_by_hand(spark, rows, block)
    held = Counter()
    for x in mixing.mixed_documents(docs, block_words=block).collect():
        held[x["doc_id"]] += len(_WORD.findall(x["text"]))
    want = Counter()
    for (i, _, n), times in got.items():
        want[i] += n * times
    assert held == +want


def test_blocks_have_one_length_and_pieces_are_blocks(spark):
    """The same at every size of a source; a piece ends where a block or its document does."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    plan = mixing.mix_plan(*[mixing._rows(docs, "doc_id")] * 2)
    assert [r[0] for r in plan.select("block_words").distinct().collect()] == [mixing.BLOCK_WORDS]
    starts = {r["doc_id"]: (r["word_from"], r["size"], r["part_from"], r["part_to"]) for r in plan.collect()}
    texts = {r["doc_id"]: _WORD.findall(r["text"]) for r in docs.collect()}
    inner = 0
    for r in mixing.mixed_documents(docs).collect():
        start, size, *part = starts[r["doc_id"]]
        # Blocks that do not follow one another stand on lines of their own.
        words = _WORD.findall(r["text"])
        if len(words) < size:
            ends = {0, size, *(e - start for e in part)} | {b - start for b in range(0, start + size + 1, mixing.BLOCK_WORDS)}
            cuts = [i for i in ends if 0 <= i <= size]
            assert any(texts[r["doc_id"]][i : i + len(words)] == words for i in cuts) or "\n" in r["text"]
            inner += 1
    assert inner


def test_mixed_documents_hold_what_is_counted(documents, crowded):
    rows = [(i, prose(i, 5 + i % 50), "abc"[i % 3]) for i in range(300)] + [(900, None, "a"), (901, " ", "b"), (5, prose(5, 10), "c")]
    docs = documents(rows)
    counts = Counter()
    for r_ in mixing.mix_counts(docs).collect():
        counts[r_["doc_id"]] += r_["taken"]
    mixed = mixing.mixed_documents(crowded(docs).drop("size"))
    assert mixed.columns == crowded(docs).drop("size").columns
    held = Counter()
    texts = {(i, t) for i, t, _ in rows}
    for r_ in mixed.collect():
        assert r_["n_chars"] == len(r_["text"])
        held[r_["doc_id"]] += len(_WORD.findall(r_["text"]))
        source_words = [_WORD.findall(t) for i, t in texts if i == r_["doc_id"]]
        assert any(set(_WORD.findall(r_["text"])) <= set(w) for w in source_words)
    assert held == Counter({k: v for k, v in counts.items() if v})
    assert mixing.mixed_documents(docs.limit(0)).collect() == [] == mixing.mix_counts(docs.limit(0)).collect()


def test_permutations_and_draws():
    for size in (1, 2, 3, 10, 1000):
        for key in (0, 7):
            there = mixing.permuted(np.arange(size), size, key)
            assert sorted(there) == list(range(size))
            assert mixing.permuted(there, size, key, back=True).tolist() == list(range(size))
    counts = np.array([5000, 0, 300, 12345])
    shards = list(mixing.shard_counts(counts, 100, 0, 10**9, 1))
    assert sum(h.sum() for *_, h in shards) == counts.sum() and (sum(h for *_, h in shards) == counts).all()
    assert all(h.sum() == 100 for *_, h in shards[:-1])
    some = list(mixing.shard_counts(counts, 100, 40, 43, 1))
    assert [(s, b.tolist(), h.tolist()) for s, b, h in some] == [(s, b.tolist(), h.tolist()) for s, b, h in shards[40:43]]


# --- Quality rules --------------------------------------------------------------------


def test_halves_of_very_many_slots_are_drawn():
    counts = np.array([700_000_000, 1_300_000_000, 0, 5, 10_000])
    total = int(counts.sum())
    take = total // 4
    halves = np.array([mixing._halve(counts, take, np.random.default_rng(i)) for i in range(400)])
    assert (halves.sum(1) == take).all() and (halves >= 0).all() and (halves <= counts).all()
    share = counts / total
    spread = np.sqrt(take * share * (1 - share) * (total - take) / (total - 1))
    assert (abs(halves.mean(0) - take * share) <= 4 * spread / 20).all()
    assert np.allclose(halves.std(0)[[0, 1, 4]], spread[[0, 1, 4]], rtol=0.15)


def measures(text):
    words = _WORD.findall(text or "")
    three = list(zip(words, words[1:], words[2:]))
    often = Counter(three)
    covered = {i + k for i, w in enumerate(three) if often[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if _WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def junk(seed):
    return "\n".join(" | ".join(prose(seed * 31 + i, 12).split()) for i in range(6))


def test_quality_measures_and_verdicts(spark, documents, crowded, odd_texts):
    good = [(1000 + i, "\n".join(prose(i * 7 + k, 20).capitalize() + "." for k in range(5))) for i in range(40)]
    bad = [(2000 + i, junk(i)) for i in range(40)]
    rows = list(enumerate(odd_texts)) + good + bad + [(None, prose(4, 80)), (1000, good[0][1])]
    known = [(i, 1) for i, _ in good[:20]] + [(i, 0) for i, _ in bad[:20]] + [(None, 1), (5, None), (1039, 0), (1039, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int")
    docs = crowded(documents(rows)).drop("n_words", "kept")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == len(rows)
    text_of = {}
    for i, t in rows:
        text_of.setdefault(i, t)
    for r in got:
        m = measures(text_of[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == m
        assert r["base_failed"] == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {i for i, _ in good} <= kept and not {i for i, _ in bad} & kept
    held = quality.quality_kept(docs, labels)
    assert held.columns == docs.columns
    assert Counter(r["doc_id"] for r in held.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_quality_without_labels_and_without_rows(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents([(1, junk(1)), (2, prose(1, 80))])
    assert [r["kept"] for r in quality.quality_report(docs, labels).orderBy("doc_id").collect()] == [not quality_fails(junk(1)), True]
    assert quality.quality_report(docs.limit(0), labels).collect() == []


def quality_fails(text):
    m = measures(text)
    return m[0] < 50 or 100 * m[4] > 50 * m[0]


def likelihood(theta, texts, labels):
    """Log-likelihood by plain forward sums, text by text."""
    emit, start, move = np.split(theta, [quality.N_FEATURES, quality.N_FEATURES + 2])
    move, total = move.reshape(2, 2), 0.0
    for x, y in zip(texts, labels):
        score = np.stack([np.zeros(len(x)), x @ emit], 1)
        ways = start + score[0]
        own = ways[y[0]]
        for t in range(1, len(x)):
            ways = np.logaddexp(ways[0] + move[0], ways[1] + move[1]) + score[t]
            own += move[y[t - 1], y[t]] + score[t, y[t]]
        total += own - np.logaddexp(*ways)
    return total


def test_gradient_is_that_of_the_likelihood():
    r = np.random.default_rng(12)
    texts = [r.normal(size=(n, quality.N_FEATURES)) for n in (1, 7, 2, 40, 1, 13)]
    labels = [r.integers(0, 2, len(x)) for x in texts]
    theta = r.normal(size=quality.N_FEATURES + 6)
    begins = np.concatenate([np.arange(len(x)) == 0 for x in texts])
    got = quality.gradient(theta, np.concatenate(texts), begins, np.concatenate(labels))
    for i in range(len(theta)):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        slope = (likelihood(theta + step, texts, labels) - likelihood(theta - step, texts, labels)) / 2e-5
        assert got[i] == pytest.approx(slope, rel=1e-5, abs=1e-5)


def test_training_takes_whole_texts_and_agrees_with_held_out_labels(spark, documents, monkeypatch):
    long = "\n".join(prose(i, 8) for i in range(700))
    docs = documents([(i, long if i == 3 else f"{prose(i, 9)}\n{i}") for i in range(40)] + [(50, None), (3, long)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(50, 1), (51, 0), (None, 1), (4, 1)], "doc_id long, quality int")
    fitted = []
    monkeypatch.setattr(quality, "train", lambda lines, content: fitted.append((lines, content)))
    quality.trained(docs, labels)
    sizes = sorted(len(x) for x in fitted[0][0])
    assert sizes == [2] * 38 + [700] and sorted(fitted[0][1]) == [0] * 19 + [1] * 20
    # What doesn't fit is left out as a whole, and shorter texts after it still go in.
    monkeypatch.setattr(quality, "TRAIN_LINES", 100)
    quality.trained(docs, labels)
    assert sorted(len(x) for x in fitted[1][0]) == [2] * 38
    monkeypatch.undo()

    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    monkeypatch.setattr(quality, "TRAIN_DOCS", 200)
    used = [row[0] for row in quality.sampled(docs, labels)]
    held = quality.quality_report(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where(~F.col("doc_id").isin(used))
    right = ((F.col("content_share") >= 0.5) == (F.col("quality") == 1)).cast("int")
    shares = {r["quality"]: r["right"] for r in held.where("n_words >= 50").groupBy("quality").agg(F.avg(right).alias("right")).collect()}
    assert shares[1] > 0.98 and shares[0] > 0.9


def test_viterbi_finds_the_best_labelling():
    r = np.random.default_rng(0)
    model = {"emit": r.normal(size=3), "start": r.normal(size=2), "move": r.normal(size=(2, 2))}
    lengths = [0, 1, 5, 3, 7, 1]
    row = np.repeat(np.arange(len(lengths)), lengths)
    features = r.normal(size=(len(row), 3))
    got = quality.viterbi(model, features, row, len(lengths))

    def score(labels, x):
        s = model["start"][labels[0]] + sum((x[i] @ model["emit"]) * y for i, y in enumerate(labels))
        return s + sum(model["move"][a, b] for a, b in zip(labels, labels[1:]))

    for k, n in enumerate(lengths):
        if n:
            x = features[row == k]
            best = max(([int(b) for b in f"{v:0{n}b}"] for v in range(2**n)), key=lambda y: score(y, x))
            assert got[row == k].tolist() == best


# --- Line dedup -----------------------------------------------------------------------


def lines_by_hand(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            if first.setdefault(tuple(lines[p : p + 3]), (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_windows(documents, crowded, odd_texts):
    r = random.Random(2)
    pool = ["a", "b", "c", "", "d e", "f"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(odd_texts)] + [(200, "x\n" * 50), (None, "a\nb\nc")]
    docs = crowded(documents(rows))
    got = without_repeated_windows(docs)
    assert got.columns == [*(c for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed"]
    assert without_repeated_windows(docs, counts=False).columns == docs.columns
    assert {r_["doc_id"]: (r_["text"], r_["n_lines"], r_["n_removed"]) for r_ in got.collect()} == lines_by_hand(rows)


def test_line_windows_of_repeated_rows_and_empty_tables(documents):
    docs = documents([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd")])
    got = sorted((r["doc_id"], r["text"]) for r in without_repeated_windows(docs).collect())
    assert got == [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "d")]
    assert without_repeated_windows(docs.limit(0)).collect() == []


def test_a_window_in_every_document(spark, conf, documents):
    """What the hot join reads on its other side is a table, so that it may be split."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    rows = [(i, f"{prose(i, 4)}\nAll rights\nare\nreserved\n{prose(i + 9000, 4)}\n{i}") for i in range(3000)]
    got = without_repeated_windows(documents(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    hot = plan[plan.index("SortMergeJoin [w1") :]
    assert hot.count("Aggregate") == 0 and "Python" not in plan and "Arrow" not in plan
    assert got.where("n_removed = 3").count() == 2999


# --- Near duplicates ------------------------------------------------------------------


def shingle_counts(text):
    w = _WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def probability_jaccard(a, b):
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in a.keys() | b.keys())
    return total


def classes_by_hand(rows):
    sets = {i: shingle_counts(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicate_classes(documents, crowded, odd_texts, monkeypatch, block):
    monkeypatch.setattr(probminhash, "BLOCK", block)
    base, other = prose(50, 120), prose(51, 200) + " and " * 30
    rows = list(enumerate(odd_texts)) + [(50 + i, prose(i + 80, 40 + i)) for i in range(20)]
    rows += [(100 + i, edited(base, i, i % 6)) for i in range(60)] + [(200 + i, edited(other, i, i % 4)) for i in range(30)]
    rows += [(300, "four words only here"), (301, "four  words\nonly here"), (302, "four words only"), (None, base), (7, odd_texts[7])]
    got = probminhash.near_duplicates(crowded(documents(rows)).drop("a", "b", "key", "kept", "node"))
    want = classes_by_hand(rows)
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["class_id"] is None and r["kept"]
        else:
            assert r["class_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["class_id"])
    assert got.count() == len(rows)


def keyed_texts(docs):
    """Texts as the comparison in blocks takes them, each a class of its own."""
    texts = probminhash.written(probminhash._keyed(docs), "keyed")
    return texts, texts.select("rep", "key_a", F.col("rep").alias("c"))


@pytest.mark.parametrize("joined", [False, True])
def test_every_link_between_classes_is_met_in_blocks(documents, monkeypatch, joined):
    """Against all pairs: texts of many sizes around the threshold, some with repeated shingles."""
    monkeypatch.setattr(probminhash, "BLOCK", 3)
    bases = [prose(400, 60), prose(401, 60) + " tail of it" * 12, prose(402, 150)]
    r, rows = random.Random(9), []
    for i in range(90):
        words = edited(bases[i % 3], i, i % 5).split()
        cut = r.randrange(0, len(words) // 5)  # shorter texts, whose share in common is near the threshold
        rows.append((i, " ".join(words[: len(words) - cut])))
    texts, mixed = keyed_texts(documents(rows))
    if joined:  # a class that weighs most in many groups; its members need no links
        mixed = mixed.withColumn("c", F.when((F.col("rep") % 3 == 0) & (F.col("rep") < 60), 0).otherwise(F.col("c")))
    links = probminhash._linked_in_blocks(mixed, texts, 0.8).collect()
    sets = {i: shingle_counts(t) for i, t in rows}
    assert all(probability_jaccard(sets[x["a"]], sets[x["b"]]) >= 0.8 - 1e-9 for x in links)
    near = [(a, b) for a in sets for b in range(a) if probability_jaccard(sets[a], sets[b]) >= 0.8 - 1e-9]
    given = [(i, 0) for i in range(0, 60, 3)] if joined else []
    assert len(near) > 200

    def parts(edges):
        parent = list(range(len(rows)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
        return [root(i) for i in range(len(rows))]

    assert parts(given + [(x["a"], x["b"]) for x in links]) == parts(given + near)


def test_pages_of_one_template_do_not_meet(documents, monkeypatch):
    """Alike, but less than the threshold: what moves grows with the pages, not with their pairs."""
    common, moved = prose(500, 100).split(), []
    for n in (150, 600):
        rows = [(i, " ".join(common[:50] + prose(1000 + i, 18).split() + [f"own{i}x{k}" for k in range(18)] + common[50:])) for i in range(n)]
        texts, mixed = keyed_texts(documents(rows))
        sets = probminhash._shingled(texts).join(mixed, ["rep", "key_a"])
        prefixes = probminhash.written(probminhash._prefixes(sets, 0.8), "prefixes")
        moved.append(prefixes.count())
        assert probminhash._dealt(prefixes).count() <= n
    assert moved[1] <= 5 * max(moved[0], 150)


def test_texts_of_one_id_are_one_document(documents):
    a, b, c, d = (prose(600 + i, 90) for i in range(4))
    rows = [(1, a), (1, b), (2, edited(a, 1, 1)), (3, edited(b, 2, 1)), (5, c), (6, c), (6, d), (6, c), (7, edited(d, 3, 1)), (8, prose(610, 90))]
    got = probminhash.near_duplicates(documents(rows)).collect()
    assert sorted((r["doc_id"], r["class_id"]) for r in got) == sorted(
        (i, {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 8}[i]) for i, _ in rows
    )


def test_one_of_each_class_stays(documents):
    base = prose(1, 100)
    docs = documents([(1, base), (2, base), (3, edited(base, 1, 1)), (4, prose(2, 100)), (5, ""), (6, None)])
    kept = probminhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert probminhash.near_duplicates(docs.limit(0)).collect() == []


def test_sketches_estimate_probability_jaccard():
    r = random.Random(1)
    for share in (0.5, 0.9):
        items = list(range(1, 400))
        a = {i: r.randint(1, 4) for i in items if r.random() < share}
        b = {i: r.randint(1, 4) if r.random() < 0.2 else a.get(i, 1) for i in items if r.random() < share}
        want = probability_jaccard(a, b)
        pairs = []
        for x in (a, b):
            keys = np.array(sorted(x), np.uint64)
            pairs.append((keys, np.array([x[int(k)] for k in keys])))
        assert probminhash.similarity(*pairs[0], *pairs[1]) == pytest.approx(want)
        hits = []
        for salt in range(8):
            row = np.repeat([0, 1], [len(pairs[0][0]), len(pairs[1][0])])
            item = np.concatenate([p[0] for p in pairs]) + np.uint64(salt * 10**6)
            kept = probminhash.sketches(row, item, np.concatenate([p[1] for p in pairs]), 2)
            hits.append((kept[0] == kept[1]).mean())
        assert abs(np.mean(hits) - want) < 0.06


# --- Repeated strings -----------------------------------------------------------------


def removed_by_hand(rows, length=50):
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_repeated_strings(documents, crowded, odd_texts, monkeypatch, small):
    if small:  # many buckets, deals, batches and levels
        for name, value in (("BUCKET_BYTES", 3000), ("DEAL_BYTES", 5000), ("BATCH", 300), ("HOT_BYTES", 6000), ("SAMPLED", 2)):
            monkeypatch.setattr(suffix_family, name, value)
    r = random.Random(4)
    passages = [prose(900 + i, n) for i, n in enumerate((7, 9, 12, 30, 100))]
    rows = [(i * 3 % 101, prose(i, r.randint(0, 60)) + " " + r.choice(passages) + prose(i + 500, r.randint(0, 30)) + r.choice(passages)) for i in range(100)]
    rows += [(200 + i, t) for i, t in enumerate(odd_texts)] + [(300, "ab" * 200), (301, "ba" * 100), (302, "a" * 49), (303, "\x00" * 60), (304, "\x00" * 51)]
    rows += [(None, passages[4]), (7, passages[4]), (305, "é" * 40), (306, "x" + "é" * 30)]
    got = suffix_family.repeats_removed(crowded(documents(rows)).drop("tag", "span", "bucket"))
    found = sorted(((r_["doc_id"], r_["n_bytes"], r_["n_removed"], r_["n_spans"], r_["kept_sha256"]) for r_ in got.collect()), key=str)
    assert found == removed_by_hand(rows)


def test_repeated_strings_of_empty_and_short_tables(documents):
    docs = documents([(1, None), (2, "short"), (3, "short")])
    assert sorted(r["n_removed"] for r in suffix_family.repeats_removed(docs).collect()) == [0, 0, 0]
    assert suffix_family.repeats_removed(docs.limit(0)).collect() == []


def removed_rows(df):
    return sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in df.collect()), key=str)


def repeating_rows(n, seed=4):
    r = random.Random(seed)
    passages = [prose(900 + i, k) for i, k in enumerate((7, 9, 12, 30, 100))]
    return [(i, f"{prose(i, r.randint(0, 60))} {r.choice(passages)}{prose(i + 5000, r.randint(0, 30))}{r.choice(passages)}") for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_batches_against_the_levels_of_earlier_ones(documents, monkeypatch, small):
    """Four batches by ascending id give what one run gives, and levels merge."""
    if small:
        for name, value in (("BUCKET_BYTES", 3000), ("DEAL_BYTES", 5000), ("BATCH", 300), ("HOT_BYTES", 4000), ("SAMPLED", 1)):
            monkeypatch.setattr(suffix_family, name, value)
    rows = repeating_rows(80) + [(200, "é" * 60), (201, "x" + "é" * 50)]
    rows.sort()
    family, got, counts = None, [], []
    for at in range(0, len(rows), 21):
        out, family = suffix_family.batch_removed(documents(rows[at : at + 21]), family)
        got += removed_rows(out)
        counts.append([n for n, _ in family.levels])
    assert sorted(got, key=str) == removed_by_hand(rows)
    assert len(counts) == 4 and all(2 * b <= a for level in counts for a, b in zip(level, level[1:]))
    assert sum(counts[-1]) == len({t.encode()[p : p + 50] for _, t in rows for p in range(len(t.encode()) - 49)})


def test_suffix_arrays_and_merge_scans():
    r = random.Random(3)
    make = lambda seed: np.frombuffer(("".join(r.choice(["ab", "abc", prose(seed, 3), "x" * 30]) for _ in range(60)) + "\0" * 8).encode(), np.uint8)
    levels = []
    for seed in (1, 2):
        text = make(seed)
        at = np.arange(len(text) - 8 - 49)
        order, new = suffix_family.suffix_order(text, at)
        strings = [text[i : i + 50].tobytes() for i in at]
        assert [strings[i] for i in order] == sorted(strings) and new.sum() == len(set(strings))
        levels.append(suffix_family.Level(text, at[order][new], np.full(int(new.sum()), seed)))
    order, new, both = suffix_family.merge_scan(*levels)
    strings = [both.text[i : i + 50].tobytes() for i in both.places]
    assert [strings[i] for i in order] == sorted(strings) and new.sum() == len(set(strings))


def test_a_frequent_k_mer_is_dealt_by_its_contexts(documents, monkeypatch):
    """Its bucket stays level while the table grows; the same is removed."""
    for name, value in (("BUCKET_BYTES", 40_000), ("HOT_BYTES", 200_000), ("SAMPLED", 1)):
        monkeypatch.setattr(suffix_family, name, value)
    hasher = suffix_family.Hasher()
    low = min((f"{a}{b}{c}{d}tion " for a in "abcdefgh" for b in "abcdefgh" for c in "abc" for d in "abc"), key=lambda k: int(
        hasher.ranges(hasher.sums(np.frombuffer(k[:8].encode(), np.uint8)), np.array([0]), np.array([8]))[0]))
    largest = []
    for n in (300, 1200):
        rows = [(i, " ".join(low + prose(i * 50 + k, 6) for k in range(20))) for i in range(n)]
        if n == 300:
            rows += [(n + i, rows[i][1][100:400]) for i in range(5)]
            assert removed_rows(suffix_family.repeats_removed(documents(rows))) == removed_by_hand(rows)
        docs = documents(rows)
        deal = suffix_family._deal(docs)
        assert len(deal.hot)
        sizes = Counter()
        for r in suffix_family._dealt(suffix_family._tagged(docs), deal).collect():
            if r["bucket"] >= 0:
                sizes[r["bucket"]] += len(suffix_family.unpacked(r["payload"])[-1])
        largest.append(max(sizes.values()))
    assert largest[1] < 1.5 * largest[0]


def test_rows_that_share_an_id_keep_their_own_ranges(documents):
    """Many rows of one id, of which only some hold a passage of a smaller document."""
    passage = prose(1, 30)
    rows = [(1, passage)] + [(5, f"{prose(100 + i, 20)} {passage if i % 3 == 0 else prose(900 + i, 30)} {i}") for i in range(700)]
    rows += [(5, rows[1][1]), (6, passage), (6, passage)]
    assert removed_rows(suffix_family.repeats_removed(documents(rows))) == removed_by_hand(rows)


def test_strings_whose_minimizer_recurs(documents):
    r = random.Random(12)
    rows = []
    for g in range(40):
        word = "".join(r.choice("abcdefghijkl") for _ in range(7)) + " "
        passage = prose(900 + g, 12)
        for n in r.sample([2, 3, 4], 3):
            rows.append((len(rows), prose(5000 + len(rows), 12) + " " + word * n + passage))
    got = suffix_family.repeats_removed(documents(rows))
    found = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got.collect()), key=str)
    assert found == removed_by_hand(rows)
