"""Rows of every stage of the pipeline against a plain version, on nulls, shared ids, clashing names and empty tables."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import _bag, _groups, _plain_tiles, _similar
from tidemark.llm import bpe_tree, byte_cnn, catalog, words

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, removed string, same int, __doc int, __hash int, __lines int, __same int, key int, `odd name` int"


def _line(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(9)
    items = [(k, _line(rnd, 30)) for k in range(4)] + [(None, _line(rnd, 25)), (2, None), (5, ""), (6, "two words")]
    english = "the people of the town went to the market and found that it was closed for the day because of the rain "
    german = "die leute der stadt gingen auf den markt und sahen dass er wegen des regens den ganzen tag geschlossen war "
    texts = [(i, (english if i % 2 else german) + _line(rnd, 40), "en" if i % 2 else "de") for i in range(60)]
    texts += [(100 + i, texts[i][1] + (" more" if i % 3 else ""), "en") for i in range(9)]
    head = "a header line that stands on every page"
    texts += [(200 + i, head + "\n" + _line(rnd, 30), "en") for i in range(6)]
    texts += [(5, "the clean one of two texts that share an id " + _line(rnd, 40), "en"), (5, "the other holds a passage " + items[0][1] + " and ends", "en")]
    texts += [(None, "no id and a passage " + items[1][1], "en"), (None, "no id and clean " + _line(rnd, 40), None), (None, "no id and clean " + _line(rnd, 40), None)]
    w = items[2][1].split()
    texts += [(300, "reordered " + " ".join(w[15:] + ["between"] + w[:15]), "en"), (301, items[4][1], "en"), (302, " ".join(w[:9]) + " " + _line(rnd, 50), "en")]
    texts += [(400, None, "en"), (401, "", "en"), (402, "123 456 ... !", "en"), (403, " \n\t", None), (404, "x", "en"), (405, "long " * 20_000, "en"), texts[3], texts[3]]
    rows = [(i, t, lang, "s", len(t or ""), 0.5, "zz", "r", 1, 2, 3, 4, 5, 6, 7) for i, t, lang in texts]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def _hash_of(spark, rows):
    texts = sorted({t or "" for _, t in rows})
    return {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


def _plain_lines(rows, hashed):
    # A document for each id and text, and for each row without an id.
    order = sorted({(i is not None, i or 0, hashed[t or ""], k if i is None else 0, t or "") for k, (i, t) in enumerate(rows)}, key=lambda x: x[:4])
    before, want = [], Counter()
    for known, i, _, _, t in order:
        kept, left = [], False
        for x in t.split("\n"):
            own = frozenset(x.lower().split())
            if not own or not any(len(own & o) >= 0.8 * len(own | o) - 1e-9 for o in before):
                kept.append(x)
                left |= bool(own)
            before += [own] if own else []
        if left or not t.strip():
            want[i if known else None, "\n".join(kept)] += sum((j, x or "") == (i, t) for j, x in rows) if known else 1
    return want


def _plain_near(rows):
    named = sorted({(i, t or "") for i, t in rows if i is not None})
    bags = {x: _bag(x[1]) for x in named}
    root = _groups(named, lambda x, y: x[1] == y[1] or _similar(bags[x], bags[y]) >= 0.8)
    return len(set(root)), Counter((i, t) for i, t in rows if i is None)


def _plain_held(text, items):
    t = (text or "").lower().replace(".", " ").split()
    for _, item in items:
        w = (item or "").split()
        if len(w) >= 5:
            ids = {x: n for n, x in enumerate(dict.fromkeys([*w, *t]))}
            if set(w) & set(t) and sum(x[2] for x in _plain_tiles([ids[x] for x in w], [ids[x] for x in t], 5)) >= 0.6 * len(w):
                return True
    return False


def test_each_stage_equals_its_plain_version(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = _rows(docs)

    kept = STAGES["language"](spark, docs, folder).cache()
    assert kept.columns == columns and Counter(_rows(kept)) == Counter((i, t) for i, t in before if any(c.isalpha() for c in t or ""))
    named = {r["doc_id"]: r["lang"] for r in kept.select("doc_id", "lang").collect() if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] != 5}
    assert sum(lang == ("en" if i % 2 else "de") for i, lang in named.items()) >= 0.9 * len(named)  # some German texts are labelled en
    assert {tuple(r) for r in kept.select("score", "lang_pred", "removed", "odd name").collect()} == {(0.5, "zz", "r", 7)}

    before = _rows(kept)
    lines = STAGES["lines"](spark, kept, folder).cache()
    assert lines.columns == columns and Counter((i, t or "") for i, t in _rows(lines)) == _plain_lines(before, _hash_of(spark, before))
    assert all(r["n_chars"] == len(r["text"] or "") for r in lines.collect())

    before = _rows(lines)
    near = STAGES["near_duplicates"](spark, lines, folder).cache()
    groups, nameless = _plain_near(before)
    after = _rows(near)
    assert near.columns == columns and sum(i is not None for i, _ in after) == groups and Counter((i, t) for i, t in after if i is None) == nameless
    assert not set(after) - set(before)

    clean = STAGES["benchmark"](spark, near, folder).cache()
    want = Counter((i, t) for i, t in after if not (len(t or "") < 20_000 and _plain_held(t, items)))
    assert clean.columns == columns and Counter(_rows(clean)) == want
    ids = Counter(i for i, _ in _rows(clean))
    assert ids[5] >= 1 and 300 not in ids and 301 not in ids and 302 in ids and not any("and a passage" in t for _, t in _rows(clean))

    out = STAGES["tokens"](spark, clean, folder).collect()
    bpe = bpe_tree.ByteBPE(bpe_tree.read_ranks(catalog.BYTE_RANKS), catalog.PATTERN)
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in out) == Counter((i, bpe.encode(t or "")) for i, t in _rows(clean))


def test_the_run_is_its_stages_and_takes_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder)
    assert Counter(map(str, corpus_pipeline.run(spark, folder).collect())) == Counter(map(str, kept.collect()))
    empty = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() < docs.count() and out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_the_language_sample_is_bounded(spark):
    """Many equal rows without an id must not all reach the driver."""
    rows = [(None, "the same text of a third of all rows", "en")] * 3000 + [(i, f"text {i} of the other rows", "en") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    keep = byte_cnn.train

    def train(windows, target, labels, **more):
        seen.append(len(windows))
        return keep(windows, target, labels, steps=2)

    byte_cnn.train = train
    try:
        byte_cnn.fit(df, per_label=50, windows_per_row=3)
    finally:
        byte_cnn.train = keep
    assert seen == [150]


def test_the_reduction_runs_on_given_texts(spark, monkeypatch):
    """Texts and pieces of the given table are joined from halves, and decoding joins leaves."""
    calls = Counter()
    for name in ("join", "join_pieces", "_leaf"):
        own = getattr(bpe_tree.ByteBPE, name)
        monkeypatch.setattr(bpe_tree.ByteBPE, name, lambda self, *a, own=own, name=name: (calls.update([name]), own(self, *a))[1])
    bpe = bpe_tree.ByteBPE(bpe_tree.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert bpe.decode(np.frombuffer(bpe.encode(t), "<u4")) == t.encode()
    assert calls["join_pieces"] > len(texts) / 3 and calls["join"] > 20 and calls["_leaf"] >= len(texts)


def test_shielded_columns_come_back(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id int, text string, `a.b` int")
    inner, restore = words.shielded(df.withColumnRenamed("a.b", "x y"), ("text",))
    assert inner.columns == ["__kept0", "text", "__kept2"] and restore(inner).columns == ["doc_id", "text", "x y"]
