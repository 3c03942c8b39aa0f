import hashlib
import re

from echofold.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shared(w, p, x, q):
    k = 0
    while p + k < len(w) and q + k < len(x) and w[p + k] == x[q + k]:
        k += 1
    return k


def places(w, x, n):
    """(item word, document word) of every occurrence of a window."""
    for q in range(max(1, len(x) - n + 1) if x else 0):
        win = x[q : q + n]
        yield from ((q, p) for p in range(len(w) - len(win) + 1) if w[p : p + len(win)] == win)


def brute(docs, items, n=13):
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, s in items:
            x = words(s)
            for k in range(max(1, len(x) - n + 1) if x else 0):
                win = x[k : k + n]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        ids.add(str(i))
        best = max(((shared(w, p, words(s), q), -p) for i, s in items for q, p in places(w, words(s), n)), default=(0, 1))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), best[0], -best[1]))
    return out


PASSAGE = " ".join(f"w{k % 7}x{k}" for k in range(40))
ITEMS = [(1, PASSAGE), (2, "short Item here"), (10, PASSAGE[:200]), (3, None), (4, "..."), (5, "é" * 3 + " two"), (1, "again short")]
DOCS = [
    (1, "a b " + PASSAGE.upper() + " tail"),
    (2, None),
    (3, ""),
    (4, "x, SHORT-item; here? y " * 3),
    (5, " ".join(PASSAGE.split()[3:18]) + " z " * 400),
    (6, " ".join(PASSAGE.split()[:12])),
    (7, "ééé two again short item here"),
    (7, "ééé two again short item here"),
    (None, PASSAGE + " " + PASSAGE),
    (8, "w1 " * 5000 + PASSAGE),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for size in (1_000_000, 5):
        got = [tuple(r) for r in decontam.score(docs, items, block_words=size).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r)
        assert sorted(got, key=key) == sorted(brute(DOCS, ITEMS), key=key)


def test_long_items_only_prune_safely(spark):
    items = [(k, " ".join(f"v{(k * j) % 11}" for j in range(60))) for k in range(1, 6)]
    docs = [(k, " ".join(f"v{(3 * j + k) % 11}" for j in range(90)) + " " + items[k % 5][1]) for k in range(12)]
    got = decontam.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items))


def test_longest_and_remove(spark):
    docs = spark.createDataFrame([(*d, "n") for d in DOCS], "doc_id long, text string, n_hit string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    best = {r.item_word: r for r in decontam.longest_matches(docs, items).collect()}
    assert best[0].n_words == 40 and best[5].n_words == 35
    kept = decontam.remove(docs, items)
    assert kept.columns == ["doc_id", "text", "n_hit"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, h, _, _, c, *_ in brute(DOCS, ITEMS[:1]) if not c)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.score(docs, items).collect() == []
    assert [r.contaminated for r in decontam.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items).collect()] == [False]
    assert decontam.longest_matches(docs, items).collect() == []


def test_longest_matches_do_not_depend_on_blocks(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ITEMS)], "item_id long, text string")
    one, many = (sorted(map(tuple, decontam.longest_matches(docs, items, block_words=n).select("item_id", "item_word", "n_words").collect())) for n in (1_000_000, 5))
    want, texts = [], [words(d) for _, d in DOCS]
    for k, (_, t) in enumerate(ITEMS):
        x = words(t)
        for q in range(len(x)):
            n = max(shared(w, p, x, q) for w in texts for p in range(len(w) or 1))
            if n >= decontam.LEAST_MATCH:
                want.append((str(k), q, n))
    assert one == many == sorted(want)


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, PASSAGE, 5, "x"), (2, "clean", 6, "y")], "doc_id long, text string, longest_match int, contaminated string")
    kept = decontam.remove(docs, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(2, "clean", 6, "y")]
