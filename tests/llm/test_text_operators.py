import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.common import table
from rasterloom.llm import gbt, leakage, packing, repetition
from rasterloom.llm.text import words

DATA = "/root/testdata/sf0.01"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


# Words.


def test_words():
    assert words("Hel-\nlo wor­ld don't x_y A1") == ["hello", "world", "don", "t", "x", "y", "a1"]
    assert words("a‐\r\nb a-b é") == ["ab", "a", "b", "é"]
    assert words("keep (drop me) [and me] keep", False) == ["keep", "keep"]
    assert words("an (open bracket", False) == ["an", "open", "bracket"]
    assert words(None) == words("") == []


# Packing.


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint")
    return [r.asDict() for r in packing.pack(df, capacity).collect()]


def check_packing(rows, sizes, capacity):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_bin[r["container_id"]].append((r["start"], r["n_tokens"]))
    assert set(by_doc) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [p["piece"] for p in parts] == list(range(len(parts)))
        assert sum(p["n_tokens"] for p in parts) == (n or 0)
        assert len(parts) == max(1, -(-(n or 0) // capacity)) and all(p["n_tokens"] == capacity for p in parts[:-1])
    for items in by_bin.values():
        end = 0
        for s, n in sorted(x for x in items if x[1]):
            assert s == end
            end = s + n
        assert end <= capacity
    return len(by_bin)


def test_packing_is_complete_and_tight(spark):
    rnd = random.Random(1)
    sizes = [rnd.choice([0, None, 1, 7, 33, 33, 33, 33, 100, 101, 250]) if rnd.random() < 0.5 else rnd.randint(1, 180) for _ in range(2000)]
    n = check_packing(packed(spark, sizes, 100), sizes, 100)
    used = sum(s or 0 for s in sizes)
    assert n <= -(-used // 100) * 1.02 + 1


def test_packing_edges(spark):
    assert packed(spark, [], 10) == []
    for sizes in ([0, 0], [None], [10], [11], [10] * 50, [6] * 5, [35, 0]):
        check_packing(packed(spark, sizes, 10), sizes, 10)
    twice = spark.createDataFrame([(1, 3), (1, 3)], "doc_id bigint, n_tokens bigint")
    assert packing.pack(twice, 10).count() == 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
def test_fullest_against_all_sums(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        for _ in range(n):
            sums |= {s + length for s in sums if s + length <= capacity}
    got = packing.fullest(counts, capacity)
    assert sum(k * v for k, v in got.items()) == max(sums)
    assert all(0 < v <= counts[k] for k, v in got.items())


def test_plan_uses_every_length_once():
    counts = Counter(random.Random(2).choices(range(1, 500), k=5000))
    steps = packing.plan(dict(counts), 512)
    used = Counter()
    for combination, times in steps:
        assert sum(k * v for k, v in combination.items()) <= 512
        for k, v in combination.items():
            used[k] += v * times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in steps) <= total / 512 * 1.01 + 1


def test_token_counts(spark):
    import tiktoken

    got = {r.doc_id: r.n_tokens for r in packing.token_counts(docs(spark, [None, "", "Hello world", "<|endoftext|>", "x" * 200_000])).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2 and got[3] > 1 and got[4] > 1000
    assert tiktoken


def test_corpus_is_packed_tightly(spark):
    sizes = packing.token_counts(table(spark, DATA, "documents"))
    boxes = packing.containers(packing.pack(sizes, 2048), 2048).collect()
    total = sum(b.used for b in boxes)
    assert all(0 <= b.unused for b in boxes) and len(boxes) <= -(-total // 2048) + 1


# Leakage.


def edit(pattern, text):
    """Least edit distance of pattern to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t or t == 0)))
        row = new
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=9, max_size=9), st.lists(st.integers(0, 4), min_size=12, max_size=12)), min_size=1, max_size=5))
def test_myers_against_dynamic_programming(pairs):
    p, t = np.array([a for a, _ in pairs]), np.array([b for _, b in pairs])
    assert leakage.myers(p, t).tolist() == [edit(a, b) for a, b in pairs]


def test_myers_long_pattern():
    rnd = random.Random(3)
    p = [[rnd.randint(1, 5) for _ in range(63)] for _ in range(5)]
    t = [[rnd.randint(1, 5) for _ in range(80)] for _ in range(5)]
    assert leakage.myers(np.array(p), np.array(t)).tolist() == [edit(a, b) for a, b in zip(p, t)]


def exact(doc_texts, item_texts, run=12):
    grams = lambda t: {tuple(w[i : i + run]) for w in [words(t, False)] for i in range(len(w) - run + 1)}
    g = {i: grams(t) for i, t in item_texts}
    return {(d, i) for d, t in doc_texts for i in g if g[i] & grams(t)}


def test_verbatim_leaks_of_the_corpus(spark):
    d, i = table(spark, DATA, "documents"), table(spark, DATA, "eval_items")
    got = [(r.doc_id, r.item_id) for r in leakage.leaks(d, i).filter("distance = 0").collect()]
    want = exact([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in i.collect()])
    assert len(got) == len(set(got)) and set(got) == want and want


W = [f"w{i}" for i in range(60)]


@pytest.mark.parametrize("block", [32 << 20, 100])
def test_near_and_verbatim(spark, block):
    item = " ".join(W[:20])
    texts = [
        "x " + " ".join(W[3:15]) + " y", " ".join(W[3:14]), " ".join(W[0:6] + ["odd"] + W[7:12]), " ".join(W[0:8] + W[9:13]), " ".join(W[0:8] + ["in"] + W[8:12]),
        " ".join(W[0:5] + ["a"] + W[6:9] + ["b"] + W[10:12]), f"{' '.join(W[:6])} (cheers [loud]) {' '.join(W[6:12])}", f"{' '.join(W[:6])} (cheers) {' '.join(W[6:12])}", None, "", " ".join(W[8:20]), "z " * 50_000 + item,
    ]
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too short"), (5, ""), (None, item), (1, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in leakage.leaks(docs(spark, texts), items, block_bytes=block).collect()}
    want = {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 0, 10: 0, 11: 0}  # of nested brackets only the inner ones go
    assert got == {(d, i): v for d, v in want.items() for i in (1, 2)}


def test_near_leaks_of_the_whole_corpus_against_dynamic_programming(spark):
    """All of sf0.01: documents that share a piece of six words with a window are compared word by word."""
    d, i = table(spark, DATA, "documents"), table(spark, DATA, "eval_items")
    got = {(r.doc_id, r.item_id): r.distance for r in leakage.leaks(d, i).collect()}
    windows = defaultdict(set)
    for r in i.collect():
        w = words(r.text, False)
        for k in range(len(w) - 11):
            windows[tuple(w[k : k + 12])].add(r.item_id)
    pieces = defaultdict(set)
    for w in windows:
        pieces[w[:6]].add((w, 0))
        pieces[w[6:]].add((w, 6))
    want = {}
    for r in d.collect():
        t = words(r.text, False)
        for at in range(len(t) - 5):
            for w, k in pieces.get(tuple(t[at : at + 6]), ()):
                lo = max(0, at - k - 1)
                found = edit(w, t[lo : at - k + 13])
                if found <= 1:
                    for item in windows[w]:
                        want[r.doc_id, item] = min(want.get((r.doc_id, item), 9), found)
    assert got == want and any(want.values())


def test_leak_tables_empty_or_repeated(spark):
    d, i = docs(spark, [" ".join(W)]), spark.createDataFrame([(1, " ".join(W))], "item_id bigint, text string")
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0
    assert leakage.leaks(d.union(d), i).count() == 1
    assert leakage.leaks(d.selectExpr("*", "1 AS item_id", "2 AS distance"), i.selectExpr("*", "3 AS doc_id")).count() == 1


# Repetition.


def share(text, run=5):
    w = words(text)
    seen, again = set(), 0
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        again += g in seen
        seen.add(g)
    return len(w), again


def test_repetition_of_the_corpus(spark):
    d = table(spark, DATA, "documents")
    got = {r.doc_id: r for r in repetition.repetition(d).collect()}
    text = {r.doc_id: r.text for r in d.collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        n, again = share(text[i])
        assert (r.n_words, r.n_again) == (n, again)
        assert r.repetitive == (n >= 30 and again >= 0.3 * (n - 4) - 1e-9)
    assert 0 < sum(r.repetitive for r in got.values()) < len(got)


def test_repetition_edges(spark):
    rnd = random.Random(4)
    plain = " ".join(str(rnd.random()) for _ in range(200))
    phrase = "one two three four five six seven "
    texts = [None, "", "   ", "word", phrase * 3, phrase * 20, plain, plain + ". " + plain, "a " * 200_000, "x-\n" * 10]
    rows = {r.doc_id: r for r in repetition.repetition(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, again = share(t)
        assert (rows[i].n_words, rows[i].n_again) == (n, again)
    assert [i for i in rows if rows[i].repetitive] == [5, 7, 8] or {i for i in rows if rows[i].repetitive} == {5, 7, 8}
    assert repetition.repetition(docs(spark, texts).limit(0)).count() == 0
    both = docs(spark, texts[:6])
    assert repetition.repetition(both.union(both)).count() == 12
    assert repetition.repetition(both.selectExpr("*", "1 AS x", "2 AS score", "3 AS n_words")).count() == 6


def test_scores_generalise(spark):
    """Held-out accuracy of the trees, which do not see the share they are to tell."""
    d = table(spark, "/root/testdata/sf0.1", "documents")
    precision, recall = repetition.held_out(d, sample_rows=8000)
    assert "share_runs" not in repetition.FEATURES and precision > 0.85 and recall > 0.85
    rows = repetition.scores(d, sample_rows=1500).collect()
    assert len(rows) == d.count() and 0 < sum(r.likely for r in rows) < len(rows) / 10


def test_scores_of_edge_cases(spark):
    texts = [None, "", "word", "a b c " * 100] + [" ".join(random.Random(i).choices(W, k=80)) for i in range(60)]
    rows = {r.doc_id: r for r in repetition.scores(docs(spark, texts)).collect()}
    assert len(rows) == len(texts) and not rows[0].likely and not rows[1].likely
    assert repetition.scores(docs(spark, texts).limit(0)).count() == 0
    assert repetition.scores(docs(spark, texts[:6]).selectExpr("*", "2 AS score")).count() == 6


def test_features_of_lines_without_a_repeated_run():
    n, again, x = repetition.statistics("one two\nthree four\none two\nthree four")
    assert (n, again) == (8, 0) and x[2] == 0.5 and x[3] == 0.5


def test_trees_learn_and_stay_monotonic():
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.3 * (x[:, 1] > 0.5) + 0.05 * rng.normal(size=3000) > 0.7).astype(float)
    t = gbt.fit(x[:2000], y[:2000], (0,))
    assert ((t.score(x[2000:]) > 0) == y[2000:]).mean() > 0.93
    base = rng.random((50, 3))
    for lo, hi in ((0.1, 0.2), (0.4, 0.7), (0.0, 1.0)):
        a, b = base.copy(), base.copy()
        a[:, 0], b[:, 0] = lo, hi
        assert (t.score(b) >= t.score(a) - 1e-12).all()


def test_trees_of_one_kind_or_no_rows():
    for x, y in ((np.zeros((0, 2)), np.zeros(0)), (np.ones((9, 2)), np.ones(9))):
        t = gbt.fit(x, y, (0,))
        assert len(set(t.score(np.ones((3, 2))))) == 1


def test_packed_rows_are_json_safe(spark):
    assert json.loads(packing.pack(spark.createDataFrame([(1, 3)], "doc_id bigint, n_tokens bigint"), 4).toJSON().first())["n_tokens"] == 3
