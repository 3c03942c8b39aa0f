import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from echofold.llm import minhash
from echofold.llm.common import byte_words
from echofold.operators.relational import connected_components


def bag(text):
    w = byte_words(text.encode())
    c = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    return {s: 1 + math.log(n) for s, n in c.items()}


def similarity(a, b):
    """Probability Jaccard by its definition."""
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in a if i in b)


def brute(rows, threshold=0.8):
    """class_id and copy_of per row, by comparing all pairs of texts."""
    texts = {}
    for d, t in rows:
        if t is not None:
            w = byte_words(t.encode())
            texts.setdefault(tuple(w) if w else (None, t), []).append(d)
    nodes = list(texts)
    bags = [bag(" ".join(x.decode() for x in n)) if n[0] is not None else {n: 1} for n in nodes]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(nodes)), 2):
        if len(bags[a].keys() & bags[b].keys()) and similarity(bags[a], bags[b]) >= threshold:
            parent[find(a)] = find(b)
    least = lambda ds: min((d for d in ds if d is not None), default=None)
    groups = {}
    for k, n in enumerate(nodes):
        groups.setdefault(find(k), []).extend(texts[n])
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, d, d))
            continue
        w = byte_words(t.encode())
        n = tuple(w) if w else (None, t)
        out.append((d, least(groups[find(nodes.index(n))]), least(texts[n])))
    brute.heads = sorted((least(g) for g in groups.values()), key=str)
    return sorted(out, key=str)


def vary(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    base = [word() for _ in range(200)]
    for _ in range(60):  # a crowd whose members are alike to the base, some of them not to each other
        rows.append(vary(rng, base, rng.randrange(1, 12)))
    chain = [word() for _ in range(120)]
    for k in range(8):  # a chain: neighbours alike, ends not
        rows.append(" ".join(chain[k * 5 :] + [f"c{k}{j}" for j in range(k * 5)]))
    for _ in range(15):
        w = [word() for _ in range(rng.randrange(1, 80))]
        rows += [" ".join(w)] * rng.randrange(1, 4) + [vary(rng, w, 1)]
    rows += ["", "", "!!", "??", "one two", "One, TWO", None, None, "line one two three four five\n" * 50 + "tail a b c d e f", "line one two three four five\n" * 49 + "tail a b c d e f"]
    out = [(k, t) for k, t in enumerate(rows)]
    return [*out, (None, rows[0]), (3, rows[3]), (5, rows[70]), (None, "only here without an id"), (None, None), (777, "q " * 30000), (778, "q " * 30001)]


def test_exact_similarity():
    rng = random.Random(1)
    for _ in range(50):
        a = " ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 30)))
        b = " ".join(rng.choice("xyz") for _ in range(rng.randrange(1, 30)))
        h = minhash.Hashes()
        got = minhash.probability_jaccard(*(minhash.shingles(byte_words(t.encode()), h) for t in (a, b)))
        assert abs(got - similarity(bag(a), bag(b))) < 1e-9


def test_signatures_estimate_it():
    rng = random.Random(2)
    h = minhash.Hashes()
    errors = []
    for _ in range(40):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 300))]
        pair = [minhash.shingles(byte_words(t.encode()), h) for t in (" ".join(w), vary(rng, w, len(w) // 30 + 1))]
        sig = minhash.signatures(pair)
        errors.append((sig[0] == sig[1]).mean() - minhash.probability_jaccard(*pair))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    alone = minhash.signatures(pair[:1])
    assert (alone[0] == sig[0]).all()


def test_classes_against_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    want = brute(rows)
    assert sorted(map(tuple, minhash.classes(df).collect()), key=str) == want
    kept = minhash.keep_one(df).collect()
    assert sorted((r.doc_id for r in kept if r.text is not None), key=str) == brute.heads
    assert sum(r.text is None for r in kept) == 3
    assert kept[0].__fields__ == ["doc_id", "text", "node"]


@pytest.mark.parametrize("block", [7])
def test_blocks_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, minhash.classes(df).collect()), key=str) == brute(rows)


def test_margin_keeps_pairs_at_the_threshold(spark):
    # similarity 0.8, signatures that agree in 83 of 125 registers
    rows = [(2 * n + k, " ".join(f"s{s}w{j}" for j in range(9 - k))) for n, s in enumerate((3303, 6178)) for k in (0, 1)]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert sorted(r[1] for r in got) == [0, 0, 2, 2]


def test_components(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent if x not in loops}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.classes(df).collect() == [] and minhash.keep_one(df).collect() == []


def test_keep_one_with_clashing_columns_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, 1, "a", "x"), (2, text.upper(), 2, "b", "y"), (2, text, 3, "c", "z"), (3, "other words here", 4, "d", "u"), (3, "other words here", 4, "d", "u"), (4, None, 5, "e", "v"), (5, "", 6, "f", "w"), (6, "", 7, "g", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Node int, mark string, head string")
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((tuple(r) for r in kept.collect()), key=str)
    assert [r[0] for r in got if r[1] is None] == [4]
    assert sorted(r[0] for r in got) == [2, 3, 4, 5] and rows[3] in got

