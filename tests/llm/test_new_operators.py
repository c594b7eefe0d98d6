"""Ball codes, stratified search and flow mixing against plain versions of their definitions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, connect
from tidemark.llm import ball_codes, catalog, flow_mix, strata_search

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_ball_codes", "op12_strata_search", "op13_flow_mix"])
def test_given_tables_equal_sql(spark, name):
    ok, why, n = compare(catalog.QUERIES[name](spark, SMALL), connect(SMALL), catalog.SQL[name])
    assert ok and n, why


# op11


def _plain_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(math.floor(256 * x) for x in r[1][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts]) for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            owned = defaultdict(list)
            for c in cut:
                owned[near(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(v) // len(v) for v in zip(*owned[i])) if i in owned else e for i, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{i:02x}" for _, i in f), e, by_label[r[2]], sha) for r, f, e in zip(kept, found, error))


@pytest.mark.parametrize(("entries", "rounds", "grid"), [(8, 2, 5), (64, 2, 3), (5, 4, 40), (3, 0, 9)])
def test_codes_equal_trying_all_entries(spark, entries, rounds, grid):
    rnd = random.Random(entries)
    rows = [(i * 7 % 300, [rnd.randrange(-grid, grid) / 16 for _ in range(12)], rnd.choice([None, 1, 2])) for i in range(300)]
    rows += [(5, None, 1), (6, [], 1), (7, [1.0, None] * 6, 1), (8, [float("nan")] + [0.0] * 11, 2), (9, [float("inf")] + [0.0] * 11, 2), (None, [0.5] * 12, None), rows[3], rows[3]]
    rows += [(1000 + i, rows[0][1], 3) for i in range(100)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, code string, ints string").repartition(3)
    out = ball_codes.compress(df, parts=4, entries=entries, rounds=rounds).collect()
    assert Counter(tuple(r) for r in out) == _plain_codes(rows, 4, entries, rounds)


def test_codes_of_empty_tables_and_wrong_lengths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ball_codes.compress(spark.createDataFrame([], schema)).count() == 0
    assert ball_codes.compress(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    odd = spark.createDataFrame([(1, [0.5] * 32, 1), (2, [0.5] * 16, 1), (3, [1e30] * 32, 1)], schema)
    assert [r["vec_id"] for r in ball_codes.compress(odd).collect()] == [1]
    with pytest.raises(ValueError):
        ball_codes.compress(spark.createDataFrame([(1, [0.5] * 20, 1)], schema))


def test_stable_cores_are_not_tried():
    rng = np.random.default_rng(1)
    centres = rng.integers(-100_000, 100_000, (32, 4))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-900, 900, (4000, 4))
    code, _ = ball_codes.nearest(x, centres)
    moved = centres + rng.integers(-500, 500, centres.shape)
    got = ball_codes.again(x, code, moved)
    want = ball_codes.nearest(x, moved)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert got[2] < len(x) * 3  # of 32 entries


# op12


def _plain_search(docs, items, top):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [(i, Counter(term(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n_docs, n_terms = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in words:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in term(text) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(scored)[:top])]
    return Counter(out)


def _texts(seed=3):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    docs = [(rnd.randint(-50, 400), " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 8, 8, 8, 40, 200])))) for _ in range(350)]
    docs += [(None, docs[0][1]), (None, docs[0][1]), (7, None), (8, ""), (9, "... !\x7f"), (10, "A-B_C aé日本 Ab"), docs[4], docs[4], (11, "zz " * 30_000)]
    docs += [(900 + i, "copy of one text") for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 12, 50])))) for i in range(12)]
    items += [(3, "ZZ abc"), (None, "copy text one one"), (99, None), (98, ""), (97, "unknownterm"), (96, "AÉ é B")]
    return docs, items


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_search_equals_scoring_all_documents(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(strata_search, "PART_BYTES", part_bytes)
    monkeypatch.setattr(strata_search, "BLOCK_BYTES", 600)
    docs, items = _texts()
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score long, terms int").repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = Counter(tuple(r) for r in strata_search.search(strata_search.build(d), q, 20).collect())
    assert got == _plain_search(docs, items, 20)


def test_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert strata_search.search(strata_search.build(none), item).count() == 0
    assert strata_search.search(strata_search.build(some), item.where("false")).count() == 0
    assert strata_search.search(strata_search.build(some), item).count() == 1


def test_bounds_skip_strata():
    docs, items = _texts()
    texts = [t for _, t in docs]
    n = [len(re.findall(r"\w+", t or "")) for t in texts]
    batch = strata_search._part(strata_search.pa.array([i for i, _ in docs], strata_search.pa.int64()), texts, sum(x > 0 for x in n), sum(n))
    row = next(strata_search.unpack([batch]))
    wanted = strata_search.pa.array([b"zz", b"copy"], strata_search.pa.binary())
    part, best = strata_search.Part(row, wanted), strata_search.Best(1)
    visited = part.search(np.array([0, 1]), np.array([5000, 1]), best)
    assert 0 < visited < len(row["norms"]) and best.id.tolist() == [11]


# op13


def _plain_mix(rows, most):
    """Totals by source only: words, target."""
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, out, free = sum(size.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > most * size[s]]
        if not above:
            return size, out | {s: level * weight[s] for s in free}
        out |= {s: most * size[s] for s in above}
        free -= set(above)
    return size, out


def test_mix_of_hot_repeated_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(flow_mix, "PIECE", 7)
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["b", "b", "b", "é", "a", None, "B"]), rnd.randint(0, 60)) for i in range(900)]
    rows += [(None, "hot", 5)] * 500 + [(rows[7])] * 40 + [(5000, "tiny", 1), (5001, "empty", 0), (5002, "b", 9000)]
    df = spark.createDataFrame([(i, s, "w " * n if n or i != 5001 else None, "x", 3) for i, s, n in rows], "doc_id long, source string, text string, taken string, n int").repartition(4)
    run = lambda: flow_mix.mix(df, F.array("source"), flow_mix.repeating((1, 2, 3)))
    out = run().collect()
    size, target = _plain_mix(rows, 3)
    assert Counter((r["doc_id"], r["members"][0], r["size"]) for r in out) == Counter(rows)
    taken = Counter()
    for r in out:
        assert r["source_sizes"] == [size[r["members"][0]]] and r["targets"] == pytest.approx([target[r["members"][0]]])
        assert r["taken"] <= 3 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["members"][0]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= (5 if s == "hot" else 2) for s in size)
    assert Counter(map(str, run().collect())) == Counter(map(str, out))


def test_overlapping_sources_are_routed(spark):
    rows = [(i, ["a"], 10) for i in range(30)] + [(100 + i, ["a", "b"], 10) for i in range(30)] + [(200 + i, ["b", "a", "a"], 10) for i in range(10)] + [(300, [], 10), (301, None, 10)]
    df = spark.createDataFrame([(i, m, "w " * n) for i, m, n in rows], "doc_id long, members array<string>, text string")
    out = flow_mix.mix(df, F.col("members"), lambda s: {"a": 1, "b": 1}, total=700.0).collect()
    assert len(out) == len(rows)
    by = defaultdict(int)
    for r in out:
        by[tuple(r["members"])] += r["taken"]
        assert set(r["targets"]) <= {350.0}
    # 700 words are there: each is taken once, b gets 350 of the 400 it shares with a.
    assert by == {("a",): 300, ("a", "b"): 400, (): 0}


def test_flow_is_cheapest():
    """Against all ways to split small patterns."""
    rnd = random.Random(4)
    for _ in range(30):
        patterns = [(tuple(sorted(rnd.sample(range(3), rnd.randint(1, 3)))), rnd.randint(1, 3)) for _ in range(3)]
        quotas = [rnd.randint(0, 4) for _ in range(3)]
        got = flow_mix.route(patterns, quotas, 2)
        cost = lambda size, words: max(0, words - size)

        def ways(p, left):
            if p == len(patterns):
                yield 0, 0
                return
            sources, size = patterns[p]

            def split(k, room):
                if k == len(sources):
                    yield []
                    return
                for x in range(min(room, left[sources[k]]) + 1):
                    for rest in split(k + 1, room - x):
                        yield [x, *rest]

            for s in split(0, 2 * size):
                for a, b in zip(sources, s):
                    left[a] -= b
                for words, price in ways(p + 1, left):
                    yield words + sum(s), price + cost(size, sum(s))
                for a, b in zip(sources, s):
                    left[a] += b

        best = max((w, -c) for w, c in ways(0, list(quotas)))
        own = (sum(sum(f.values()) for f in got), -sum(cost(size, sum(f.values())) for (_, size), f in zip(patterns, got)))
        assert own == best


def test_mix_of_empty_tables(spark):
    schema = "doc_id long, source string, text string"
    go = lambda rows: flow_mix.mix(spark.createDataFrame(rows, schema), F.array("source"), flow_mix.repeating((1, 2, 3))).collect()
    assert go([]) == []
    assert [(r["taken"], r["targets"]) for r in go([(1, "a", None), (2, None, " ")])] == [(0, [0.0])] * 2
