"""Each operator against its definition, worked out plainly, on a table with nulls, ties, repeats and odd texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import bag_minhash, bpe_tree, byte_cnn, catalog, components, huffman_ids, jump_shards, kneser_ney, line_join, merkle, mincut_html, string_tiling, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bag string, ids int, word int, key int, n int"


def _rows(seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = []
    for _ in range(60):
        texts.append("\n".join(line(rnd.randint(1, 14)) + rnd.choice([".", "", "!"]) for _ in range(rnd.randint(1, 9))))
    for i in range(12):  # copies with a few other words
        words = texts[i].split(" ")
        for _ in range(i % 3):
            words[rnd.randrange(len(words))] = "x" + rnd.choice(vocabulary)
        texts.append(" ".join(words))
    hot = line(60)
    for _ in range(25):  # a crowd around one text
        words = hot.split(" ")
        words[rnd.randrange(60)] = rnd.choice(vocabulary) + "q"
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], "", None, None, " \n\t ", "word", "word", "!!! ... 123", "a\x1cb <|endoftext|> ~", "z" * 5000, "Ab cD. " * 3000, "日本語 テキスト 語", "\n\n"]
    rows = [(i * 3 - 30, t) for i, t in enumerate(texts)]
    rows += [(None, "a row without an id. It has words."), (None, texts[0]), rows[5], rows[5]]
    return [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), "b", 1, 2, 3, 4) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _lost(rows, result, columns):
    """Rows as a multiset of (doc_id, columns)."""
    return Counter(tuple(r[c] for c in ["doc_id", *columns]) for r in result)


# op10


def _tiktoken():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_library_and_round_trips(docs, empty, rows):
    e = bpe_tree.encode(docs, RANKS, public_tokenizers.PATTERN)
    out = bpe_tree.decode(e, RANKS, public_tokenizers.PATTERN).collect()
    t = _tiktoken()
    want = Counter((i, np.array(t.encode_ordinary(x or ""), "<u4").tobytes(), (x or "").encode()) for i, x, *_ in rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in out) == want
    once = bpe_tree.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in once) == Counter((i, len(x) // 4, x, t) for (i, x, t), n in want.items() for _ in range(n))
    assert bpe_tree.decode(bpe_tree.encode(empty, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_tree_with_small_leaves(monkeypatch):
    monkeypatch.setattr(bpe_tree, "LEAF_BYTES", 2)
    bpe, t, rnd = bpe_tree.ByteBPE(bpe_tree.read_ranks(RANKS), public_tokenizers.PATTERN), _tiktoken(), random.Random(1)
    for leaf in (3, 7, 19):
        monkeypatch.setattr(bpe_tree, "LEAF_CHARS", leaf)
        for _ in range(300):
            s = "".join(rnd.choice(["a", "b", "th", "e", " ", "  ", "\n", "é", "'re", "'", "1", "!!", "œ"]) for _ in range(rnd.randint(0, 80)))
            ids = np.frombuffer(bpe.encode(s), "<u4")
            assert ids.tolist() == t.encode_ordinary(s)
            assert bpe.decode(ids) == s.encode()


# op7


def test_huffman_files_hold_the_ids_of_the_library(spark, docs, empty, rows, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(huffman_ids, "BUCKET_IDS", 20_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    huffman_ids.write_file(docs, path, 2, str(tmp_path / "f"))
    out = huffman_ids.read_file(spark, str(tmp_path / "f")).collect()
    t = Tokenizer.from_file(path)
    want = {}
    for i, x, *_ in rows:
        want.setdefault(i, []).append(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    got, at = {}, 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
        got.setdefault(r["doc_id"], []).append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    huffman_ids.write_file(empty, path, 2, str(tmp_path / "g"))
    assert huffman_ids.read_file(spark, str(tmp_path / "g")).count() == 0


def test_words_give_the_ids_of_the_untouched_library(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, words = Tokenizer.from_file(path), huffman_ids.Words(path)
    rnd = random.Random(8)
    pieces = ["the", "The", "été,", "naïve.", "ÀB", "x1y2", "don't", "日本", "a\xa0b", "\u3000", "<|endoftext|>", "<|startoftext|>", "  ", "\n", "\t\t", "\x1c", "ß", "ÿ.", ".", ",,", "\x85", "q" * 90, "😀", "e\u0301"]
    texts = ["".join(rnd.choice(pieces) + rnd.choice(["", " ", " ", "\r\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(400)] + [None, "", " ", "a <|endoftext|> b"]
    monkeypatch.setattr(huffman_ids, "MEMO_BYTES", 2000)
    for part in (texts[:100], texts[100:], texts, [], ["x"]):
        ids, count = words.encode(part, 2)
        want = [t.encode(x or "", add_special_tokens=False).ids + [2] for x in part]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_words_stay_from_task_to_task(monkeypatch):
    """A later task of a worker tokenizes only words that are new to it; a full memory keeps the words asked for again."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, words = Tokenizer.from_file(path), huffman_ids._words(path)
    first, second = "alpha beta. gamma, d\u00e9lta", "beta alpha gamma. newer"
    learned, learn = [], words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (learned.extend(new), learn(new)))
    words._forget()
    words.encode([first + " once" * 2 + "".join(f" once{chr(97 + i)}" for i in range(26))], 2)
    assert huffman_ids._words(path) is words
    learned.clear()
    ids, _ = words.encode([second], 2)
    assert learned == [b"newer"] and ids.tolist() == [*t.encode(second, add_special_tokens=False).ids, 2]
    monkeypatch.setattr(huffman_ids, "MEMO_BYTES", words.held - 1)
    learned.clear()
    text = "alpha beta gamma newer d\u00e9lta"
    ids, _ = words.encode([text], 2)
    assert set(learned) == {b"newer", "d\u00e9lta".encode()} and ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 2]


def test_huffman_ranges_split_rows_of_one_id(spark, tmp_path, monkeypatch):
    """Equal rows without an id fill several buckets, and ids above 16 bits are coded."""
    monkeypatch.setattr(huffman_ids, "BUCKET_IDS", 500)
    rows = [(None, "same words in each of these rows")] * 400 + [(5, "other words")] * 50 + [(i, f"row {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    huffman_ids.write_file(docs, public_tokenizers.path("word_bpe_49k.json"), 2, str(tmp_path / "f"))
    sizes = Counter(r["bucket"] for r in spark.read.parquet(str(tmp_path / "f" / "blocks")).select("bucket").collect())
    assert len(sizes) > 3
    out = sorted(huffman_ids.read_file(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in out] == sorted((i for i, _ in rows), key=lambda d: (d is not None, d or 0))
    code = huffman_ids.Code([3, 70_000, 1 << 20], [1, 2, 2])
    ids = np.array([3, 70_000, 3, 1 << 20] * 300)
    body, marks, _ = code.pack(ids)
    assert code.unpack([(body, marks, len(ids))])[0].tolist() == ids.tolist()


def test_code_lengths_are_limited_and_best():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    for most in (4, 5, 6, 12):
        lengths = huffman_ids.code_lengths(counts, most)
        assert lengths.max() <= most and math.isclose((2.0**-lengths).sum(), 1)
    assert (huffman_ids.code_lengths(counts, 12) * counts).sum() == 1 * 11 + 1 * 11 + 2 * 10 + 3 * 9 + 5 * 8 + 8 * 7 + 13 * 6 + 21 * 5 + 34 * 4 + 55 * 3 + 89 * 2 + 144


def test_parity_never_rules_out_a_similar_bag():
    rnd = random.Random(12)
    texts = []
    for n in (5, 12, 40, 300, 2000):
        base = [rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(n)]
        for cut in (0, 1, 2, n // 40, n // 15, n // 4):
            other = list(base)
            for _ in range(cut):
                other[rnd.randrange(n)] = "z" + rnd.choice("kl")
            texts.append(" ".join(other))
    g, row = bag_minhash.shingles(texts)
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    bags = [g[a:b] for a, b in zip(at, at[1:])]
    parity = bag_minhash.parities(g, row, len(texts)).view(np.uint8)
    dropped = 0
    for i in range(len(texts)):
        for j in range(i):
            differ = int(np.unpackbits(parity[i] ^ parity[j]).sum())
            allowed = (len(bags[i]) + len(bags[j])) * 0.2 / 1.8 + 1e-6
            if bag_minhash.overlap(bags[i], bags[j]) >= 0.8:
                assert differ <= allowed
            dropped += differ > allowed
    assert dropped > 100


# op3


def test_language_network(spark, docs, empty, rows):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = byte_cnn.fit(real.where(byte_cnn.fold("doc_id", 4) != 2), per_label=80)
    got = byte_cnn.predict(real.where(byte_cnn.fold("doc_id", 4) == 2), model, ("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    out = byte_cnn.predict(docs, model).collect()
    assert len(out) == len(rows)
    letters = {(i, any(c.isalpha() for c in t or "")) for i, t, *_ in rows}
    assert {(r["doc_id"], r["lang_pred"] != "und") for r in out} == letters
    nothing = byte_cnn.fit(empty)
    assert {r["lang_pred"] for r in byte_cnn.predict(docs, nothing).collect()} == {"und"}
    assert byte_cnn.predict(empty, model).count() == 0


def test_pair_tables_give_the_trained_answers():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (70, byte_cnn.WINDOW)).astype(np.uint8)
    model = byte_cnn.train(x, rng.integers(0, 3, 70), ["a", "b", "c"], steps=5)
    kept = np.maximum(np.concatenate([a.max(1) for a in byte_cnn._answers(model, x)], 1) + model.bias, 0)
    z = kept @ model.dense + model.shift
    assert np.allclose(byte_cnn.Scorer(model).log_shares(x), z - np.log(np.exp(z).sum(1, keepdims=True)), atol=1e-4)


# op4


def _jump(key, n):
    key, b, j = (key or 0) % (1 << 64), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shards(docs, empty, rows):
    out = jump_shards.shard(docs, 8).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["shard"], r["grown_shard"]) == (_jump(r["doc_id"], 8), _jump(r["doc_id"], 9))
        assert r["grown_shard"] in (r["shard"], 8)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    for s in range(8):
        own = sorted((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0) for r in out if r["shard"] == s)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert jump_shards.shard(empty, 8).count() == 0


# op2


def test_fingerprints(docs, empty, rows):
    out = merkle.fingerprints(docs).collect()
    assert len(out) == len(rows)
    order = sorted(((i is not None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t, *_ in rows))
    want = []
    for k, (known, i, _, t) in enumerate(order):
        nxt, h = order[(k + 1) % len(order)][3], len(t) // 2
        want.append((i if known else None, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out) == Counter(want)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t or "")
    prints = {}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(texts[r["doc_id"]]) == 1:
            prints.setdefault(next(iter(texts[r["doc_id"]])), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) == len(prints)
    long = [r for r in out if r["n_chars"] > 200]
    assert sum(r["near_edited"] for r in long) > 3 * sum(r["near_next"] for r in long)
    assert merkle.fingerprints(empty).count() == 0


def _plain_leaves(text):
    """Leaves (digest and length) of every paragraph."""
    def pieces(x):
        return re.findall(r"(?s).{32,254}?[a-dA-D\u0400-\u043F] |.{1,256}", x) if len(x) > 512 else [x]

    return [[hashlib.md5(x.encode()).hexdigest() + f"{len(x):03x}" for part in re.split(r"(?<=[.!?]) ", p) for x in pieces(part)] for p in text.split("\n")]


def _plain_print(text):
    leaves = _plain_leaves(text)
    paras = [hashlib.md5("".join(x).encode()).hexdigest() for x in leaves]
    sections = [[]]
    for k, p in enumerate(paras):
        sections[-1].append(k)
        if p[0] < "4" and k + 1 < len(paras):
            sections.append([])
    digest = [hashlib.md5("".join(paras[k] for k in part).encode()).hexdigest() for part in sections]
    brief = lambda x: "".join(d[:10] + d[32:] for d in x)
    written = "".join(f"{d[:12]}{{{''.join(f'{paras[k][:12]}({brief(leaves[k])})' for k in part)}}}" for d, part in zip(digest, sections))
    return hashlib.sha256("".join(digest).encode()).hexdigest() + "|" + written


def _told_likeness(a, b):
    """Likeness of two fingerprints as strings."""
    if a[:64] == b[:64]:
        return 1.0
    leaves = lambda fp: {x[i : i + 13] for x in re.findall(r"\(([^)]*)\)", fp) for i in range(0, len(x), 13)}
    weight = lambda some: sum(1 + int(x[10:], 16) for x in some)
    return min(2 * weight(leaves(a) & leaves(b)) / (weight(leaves(a)) + weight(leaves(b))), 1 - 1e-9)


def test_fingerprints_equal_plain_ones(spark):
    rnd = random.Random(4)
    words = ["word", "und", "la", "привет", "日本", "b", "😀"]
    texts = ["", "\n", "one. two! three", "x" * 5000, "日" * 700, " ".join(rnd.choice(words) for _ in range(3000)), "\n".join(" ".join(rnd.choice(words) + rnd.choice(["", "", "."]) for _ in range(rnd.randint(0, 80))) for _ in range(60))]
    out = merkle.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for r, t, nxt in zip(out, texts, texts[1:] + texts[:1]):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (_plain_print(t), _plain_print(edited))
        assert math.isclose(r["near_edited"], _told_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert math.isclose(r["near_next"], _told_likeness(r["fingerprint"], _plain_print(nxt)))
    # Texts without any sentence end still show that half of them is unchanged, and where they differ.
    assert 0.3 < out[5]["near_edited"] < 0.8 and out[5]["edit_leaf"] > 10


# op5


def _plain_tiles(item, text, least):
    a, b, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return sorted(tiles)
        n, i, j = best
        tiles.append((i, j, n))
        a[i : i + n], b[j : j + n] = [False] * n, [False] * n


def test_tiles_are_those_of_the_greedy_rule():
    rng = np.random.default_rng(4)
    for _ in range(150):
        item, text = rng.integers(0, 4, rng.integers(5, 30)).astype(np.uint64), rng.integers(0, 4, rng.integers(5, 60)).astype(np.uint64)
        free = np.ones(len(text), bool)
        assert sum(t[2] for t in string_tiling.tile(item, text, free, 3)) == sum(t[2] for t in _plain_tiles(item.tolist(), text.tolist(), 3))


def test_reordered_passages_are_found(spark, empty):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(6)] + [(9, None), (10, "too short"), (0, "again")]
    w = items[0][1].split()
    docs = [
        (1, "before " + " ".join(w[20:] + ["between"] + w[:20]) + " after"), (2, " ".join(w[:15]) + " " + " ".join(word() for _ in range(30))), (3, " ".join(x for p in zip(w, w) for x in p)),
        (4, items[3][1].upper().replace(" ", ", ")), (5, None), (6, "too short"), (7, " ".join(word() for _ in range(3000)) + " " + items[4][1]), (None, items[5][1]),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = string_tiling.contaminated(d, b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 0), (4, 3), (7, 4), (None, 5)}
    assert [r["coverage"] for r in out if r["doc_id"] == 1] == [1.0]
    assert string_tiling.contaminated(empty, b).count() == 0 and string_tiling.contaminated(d, b.where("false")).count() == 0


def test_words_by_unicode_class():
    import unicodedata

    def plain(t):
        out, open_ = [], False
        for c in t.lower():
            k = unicodedata.category(c)
            single = "\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff"
            if k[0] in "LN":
                if open_ and not single:
                    out[-1] += c
                else:
                    out.append(c)
                open_ = not single
            elif k in ("Mn", "Mc") and out and last:
                out[-1] += c
            else:
                open_ = False
            last = k[0] in "LNM"
        return out

    texts = ["a\u00a0b\u3000c\u2014d \u201cquoted\u201d \u00abmot\u00bb e\u0301te\u0301 na\u00efve\u2019s", "日本語のテキスト。次の文！abc中文def", "ภาษาไทยที่นี่ xที่y", "", None, "ends in é", "é", "語", "Ünï ＡＢ１、２", "😀word😀 한국어 단어"]
    buf, at = words.joined(texts, lower=True)
    _, doc, start, end = words.letter_words(buf, at)
    assert [[bytes(buf[a:b]).decode() for a, b in zip(start[doc == i], end[doc == i])] for i in range(len(texts))] == [plain(t or "") for t in texts]


def test_passages_beyond_ascii_and_short_items_are_found(spark):
    chinese = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(40))
    spaced = [f"w{k}" for k in range(12)]
    items = [(1, chinese), (2, " ".join(spaced)), (3, "two words"), (4, "語"), (5, None), (6, "?!")]
    docs = [(1, "前文" + chinese + "後文"), (2, "\u00a0".join(spaced)), (3, "\u2014".join(spaced)), (4, "\u201c" + " ".join(spaced) + "\u201d"), (5, "those Two, words and two words"), (6, "two other words"), (7, "日本語"), (None, "two words"), (8, "two"), (9, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    long = {(1, 1), (2, 2), (3, 2), (4, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in string_tiling.contaminated(d, b).collect()} == long
    out = string_tiling.contaminated(d, b, short=True).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in out) == Counter(long | {(5, 3), (None, 3), (7, 4)})
    assert [r["tiles"][0].asDict() for r in out if r["doc_id"] == 5] == [{"item_from": 0, "doc_from": 1, "words": 2}]


def test_near_copies_beyond_ascii_have_many_shingles():
    chinese = "".join(chr(0x4E00 + 37 * k % 5000) for k in range(200))
    for text, other in ((chinese, chinese[:100] + "x" + chinese[101:]), ("\u3000".join(f"w{k}" for k in range(200)), " ".join(f"w{k}" for k in range(200)))):
        g, row = bag_minhash.shingles([text, other])
        assert bag_minhash.overlap(g[row == 0], g[row == 1]) >= 0.8


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(string_tiling, "BLOCK_BYTES", 200)
    texts = [f"alpha{k} beta{k} gamma{k} delta{k} eps{k} zeta{k}" for k in range(9)]
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in string_tiling.contaminated(d, b).collect()) == [(k, k) for k in range(9)]


# op6


def _bag(t):
    w, out, word = (t or "").lower(), [], ""
    for c in w + " ":
        if c.isascii() and not c.isalnum():
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return Counter(tuple(out[i : i + 5]) for i in range(max(1, len(out) - 4))) if out else Counter()


def _similar(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def _groups(items, linked):
    root = list(range(len(items)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(items))]


def test_near_duplicate_groups(docs, empty, rows):
    out = bag_minhash.groups(docs).collect()
    assert len(out) == len(rows)
    items = sorted({(i, t or "") for i, t, *_ in rows if i is not None})
    bags = {x: _bag(x[1]) for x in items}
    want = {items[k][0]: items[r][0] for k, r in enumerate(_groups(items, lambda x, y: x[1] == y[1] or _similar(bags[x], bags[y]) >= 0.8))}
    assert {r["doc_id"]: r["group_id"] for r in out if r["doc_id"] is not None} == want
    assert len(set(want.values())) < len(want) - 10
    assert bag_minhash.groups(empty).count() == 0
    kept = bag_minhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(want.values())) and kept.columns == docs.columns


def test_texts_that_share_an_id_are_documents_each(spark):
    text = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(1, text(1)), (5, text(1) + " end"), (5, text(2)), (5, text(2)), (5, text(3)), (6, text(3) + " end"), (6, text(4)), (7, text(5)), (7, text(5) + " end"), (None, text(6)), (None, text(6) + " end"), (8, text(2))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in bag_minhash.keep_one(frame).collect())
    seven = [x for x in kept if x[0] == 7]
    assert len(seven) == 1 and kept == Counter([(1, text(1)), (5, text(2)), (5, text(3)), (6, text(4)), *seven, (None, text(6)), (None, text(6) + " end")])
    assert len(bag_minhash.groups(frame).collect()) == len(rows)


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(3)
    for _ in range(4):
        base = {int(x): int(rng.integers(1, 12)) for x in rng.integers(1, 2**62, 40)}
        other = {k: max(1, v + int(rng.integers(-3, 4))) for k, v in list(base.items())[6:]}
        h, row, w = zip(*[(k, i, b[k]) for i, b in enumerate((base, other)) for k in sorted(b)])
        sig = bag_minhash.signatures(np.array(h, np.uint64), np.array(row), np.array(w), 2, 8000)
        assert abs((sig[0] == sig[1]).mean() - _similar(Counter(base), Counter(other))) < 0.03


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    out = {r["id"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


# op9


def _removed(rows, similar=0.8):
    lines = sorted({(i is not None, i or 0, no, frozenset(x.lower().split())) for i, t, *_ in rows for no, x in enumerate((t or "").split("\n"))}, key=lambda x: x[:3])
    out, before = {}, []
    for known, i, no, words in lines:
        if words and any(len(words & o) >= similar * len(words | o) - 1e-9 for k, o in before if k != (known, i, no)):
            out.setdefault(i if known else None, set()).add(no)
        before.append(((known, i, no), words))
    return out


@pytest.mark.parametrize("group", [3, 256])
def test_repeated_lines(docs, empty, rows, group, monkeypatch):
    monkeypatch.setattr(line_join, "GROUP", group)
    named = [r for r in rows if r[0] is not None]
    out = line_join.repeated_lines(docs.where("doc_id is not null")).collect()
    got = {r["doc_id"]: set(r["removed"]) for r in out if r["removed"]}
    assert got == _removed(named) and len(got) > 20
    assert {r["doc_id"]: r["n_lines"] for r in out} == {i: (t or "").count("\n") + 1 for i, t, *_ in named}
    assert line_join.repeated_lines(docs).where("doc_id is null").count() == 1
    assert line_join.repeated_lines(empty).count() == 0


def test_rare_words_are_told_from_common_ones(spark):
    # In a table of too few slots nearly every one of many rare words shares its slot and looks more common than it is.
    docs = spark.range(2000, numPartitions=4).select(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(100)]).alias("text"))
    counts = np.frombuffer(line_join.rarity(docs), np.uint8)
    assert (counts > 0).sum() < 25_000
    assert np.frombuffer(line_join.rarity(docs.unionByName(docs).unionByName(docs).unionByName(docs)), np.uint8).max() >= 8


def test_all_white_space_parts_words(spark):
    near = "\u00e4 one two three four five six seven eight nine"
    rows = [(1, near), (2, near.replace(" ", "\t")), (3, near.replace(" ", "\x0b ").upper()), (4, near.replace(" ", "\r\f")), (5, near.replace(" ", "\u00a0")), (6, "\t\r"), (7, near + " ten\r")]
    out = line_join.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out if r["removed"]} == {2, 3, 4, 7}


def test_long_unlike_lines_are_no_candidates(spark, monkeypatch):
    # Lines of 150 to 400 words with a rare word in common: 64 bits of parity let nearly all of their pairs through.
    rng = np.random.default_rng(5)
    common = [f"w{i}" for i in range(3000)]
    rare = lambda i: [f"rare{i % 4}"]
    rows = [(i, " ".join(rare(i) + list(rng.choice(common, 150 + 5 * (i % 50), replace=False)))) for i in range(200)]
    rows += [(1000 + i, " ".join(rows[i][1].split()[5:] + ["new"])) for i in range(0, 200, 4)]
    seen = []
    verified = line_join._verified
    monkeypatch.setattr(line_join, "_verified", lambda pairs, *more: seen.append(pairs.distinct().count()) or verified(pairs, *more))
    out = {r["doc_id"] for r in line_join.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["removed"]}
    assert out == set(_removed(rows)) and len(out) == 50
    assert sum(seen) < 150


def test_texts_without_repeated_lines(docs, empty, rows):
    named = [r for r in rows if r[0] is not None]
    gone = _removed(named)
    want = Counter()
    for i, t, *_ in named:
        kept = "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in gone.get(i, ()))
        if i not in gone:
            want[i, t] += 1
        elif kept.strip():
            want[i, kept] += 1
    out = line_join.without_repeats(docs.where("doc_id is not null"))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want and out.columns == docs.columns
    assert line_join.without_repeats(empty).count() == 0


@pytest.mark.parametrize("group", [3, 256])
def test_repeated_lines_of_shared_ids(spark, group, monkeypatch):
    monkeypatch.setattr(line_join, "GROUP", group)
    head, near = "one header of all the pages here", "one header of all the pages there now here"
    texts = [
        (None, f"{head}\nclean line of the first\nfirst again"), (None, f"clean line of second\nsecond goes on\nand on\n{head}"), (None, "clean line of second\nsecond goes on\nand on\n" + head),
        (None, f"{head}\nthird has its own words"), (None, None), (None, ""), (None, " "), (None, " "), (7, f"seven begins\n{head}"), (7, f"{head}\nanother text of the same id"),
        (7, f"seven begins\n{head}"), (8, "seven begins\neight ends"), (9, f"{near}\nnine"), (10, head), (11, None),
    ]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    hashed = {r["text"]: r["h"] for r in frame.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    # The definition, with a document for each row without an id and for each id and text.
    order = sorted({(i is not None, i or 0, hashed[t], k if i is None else 0, t or "") for k, (i, t) in enumerate(texts)}, key=lambda x: x[:4])
    before, want = [], Counter()
    for known, i, _, _, t in order:
        kept, words_left = [], False
        for x in t.split("\n"):
            words = frozenset(x.lower().split())
            if not words or not any(len(words & o) >= 0.8 * len(words | o) - 1e-9 for o in before):
                kept.append(x)
                words_left |= bool(words)
            before += [words] if words else []
        if words_left or not t.strip():
            want[i if known else None, "\n".join(kept)] += sum((j, x or "") == (i, t) for j, x in texts) if known else 1
    out = line_join.without_repeats(frame).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in out) == want
    assert sum(head in (r["text"] or "") for r in out) == 1 and any("clean line of the first" in (r["text"] or "") for r in out)
    found = line_join.repeated_by_text(frame).collect()
    assert Counter((r["doc_id"], r["text_hash"], r["copies"], r["n_lines"]) for r in found) == Counter((i, h, sum(1 for j, x in texts if (j, hashed[x]) == (i, h)), n) for i, h, n in {(i, hashed[t], (t or "").count("\n") + 1) for i, t in texts})


def test_a_third_of_the_rows_without_an_id_keep_their_lines(spark):
    texts = [(None if k % 3 == 0 else k, "\n".join(["the same header"] * (k % 5 == 0) + [f"w{k}x{j} v{k}x{j} u{k}x{j}" for j in range(k % 7 + 1)])) for k in range(90)]
    out = line_join.without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    clean = Counter((i, x) for i, t in texts for x in t.split("\n") if x != "the same header")
    assert Counter((r["doc_id"], x) for r in out for x in r["text"].split("\n") if x != "the same header") == clean


# op8


def _model(texts):
    split = lambda t: [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({k: 32 for k in range(9, 14)}).split(" ") if w] + ["</s>"]
    train = [split(t) for t in texts]
    c1 = Counter(w for t in train for w in t)
    c2 = Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    ahead = Counter(b for _, b in c2)
    high, low = kneser_ney.discounts([sum(c == k for c in c2.values()) for k in (1, 2, 3, 4)]), kneser_ney.discounts([sum(c == k for c in ahead.values()) for k in (1, 2, 3, 4)])
    off = lambda d, c: 0 if not c else d[min(c, 3) - 1]
    n, v, pairs = sum(c1.values()), len(c1), len(c2)
    rest = sum(off(low, c) for c in ahead.values()) / pairs
    total, spread = Counter(), Counter()
    for (a, _), c in c2.items():
        total[a] += c
        spread[a] += off(high, c)

    def score(t):
        s = split(t)
        value = 0.0
        for a, b in zip(["<s>", *s], s):
            p1 = max(ahead[b] - off(low, ahead[b]), 0) / pairs + rest / (v + 1)
            value += math.log10((max(c2[a, b] - off(high, c2[a, b]), 0) / total[a] + spread[a] / total[a] * p1) if total[a] else p1)
        return len(s), sum(w in c1 for w in s), sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s), value

    return n, score


def test_kneser_ney_equals_the_formulas(docs, empty, rows, monkeypatch):
    monkeypatch.setattr(kneser_ney, "PART_KEYS", 500)
    monkeypatch.setattr(kneser_ney, "GATHER", 700)
    train = [t for i, t, *_ in rows if i is not None and i % 2 == 0]
    model = kneser_ney.fit(docs.where("doc_id % 2 = 0").select("text"))
    n, score = _model(train)
    out = kneser_ney.score(docs, model).collect()
    want = {t: score(t) for _, t, *_ in rows}
    assert len(out) == len(rows) and {r["train_tokens"] for r in out} == {n}
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, []).append(want[t])
    for r in out:
        got = (r["n_tokens"], r["n_known"], r["base_score"], r["score"])
        assert any(got[:2] == w[:2] and math.isclose(got[2], w[2], rel_tol=1e-9) and math.isclose(got[3], w[3], rel_tol=1e-9) for w in by[r["doc_id"]])
    nothing = kneser_ney.fit(empty.select("text"))
    assert {(r["train_tokens"], r["base_score"], r["score"]) for r in kneser_ney.score(docs, nothing).collect()} == {(0, 0.0, 0.0)}
    assert kneser_ney.score(empty, model).count() == 0


def test_probabilities_sum_to_one():
    _, score = _model(["a b a b c", "b c a", "a a d"])
    seen = [10 ** (score(f"a {w}")[3] - score("a zz")[3]) for w in "abcd"]
    assert all(x > 0 for x in seen)


# op1


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>A</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>Head &amp; line</h1><p>First   part<br>of it, <b>bold</b>.<p>Second &eacute;.</article></main>
<aside>Side</aside><section id="comments"><article class="comment"><p>I liked this a lot, thanks for all the work on it.</p></article></section><form><label>Mail</label></form><footer>&copy; x</footer>"""


def test_main_text_of_pages(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 30000 + "</p>"), (None, "u", PAGE), (1, "u", PAGE), (5, "u", "<nav><a href=x>only menu</a></nav>"), (6, "u", "<" * 2000 + "<!-- open")]
    out = mincut_html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    text = "Head & line\nFirst part of it, bold.\nSecond é."
    got = Counter((r["page_id"], r["text"] == text, r["n_chars"]) for r in out.collect() if r["page_id"] != 6)
    assert got == Counter({(1, True, len(text)): 2, (None, True, len(text)): 1, (2, False, 0): 1, (3, False, 0): 1, (4, False, 149999): 1, (5, False, 0): 1})
    assert mincut_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_and_deep_pages_are_read_once():
    started = time.monotonic()
    for bad in ("<a ", '<a "', "<!", "<b>", "<p><b>", "<div></x>", "<li><div><b>", "<tr><b><col>", "<a '>\"", "</x>"):
        assert isinstance(mincut_html.main_text("x " + bad * 20_000), str)
    assert time.monotonic() - started < 30  # each took minutes when tags were searched anew from every sign
    line = "A real sentence of the article, long enough to count as its text. " * 3
    deep = "<nav>" + "<div>" * 5000 + "<a href=x>Menu</a>" + "</div>" * 5000 + f"</nav><p>{line}</p>"
    assert mincut_html.main_text(deep) == line.strip()
    assert mincut_html.main_text(f'<p>{line}</p><a title="open>{line}</a>') == line.strip()  # a link through and through
    assert mincut_html.main_text(f"<p>{line}</p><svg/><p>{line}</p>") == line.strip() + "\n" + line.strip()


def test_the_cut_overrules_single_blocks():
    line = "<div>This is a sentence with about a dozen words that ends like one. And another one of the same sort follows it.</div>"
    page = f"<div>{line}<div>So it is</div>{line}</div><div><div><a href=a>One</a></div><div><a href=b>Two things</a></div><div>Go!</div><div><a href=c>Three</a></div></div>"
    found = mincut_html.blocks(page)
    gain = [mincut_html.odds(b, False) for b in found]
    keep = mincut_html.min_cut(gain, mincut_html.ties(found))
    assert [g > 0 for g in gain][:3] == [True, False, True] and keep == [True, True, True, False, False, False, False]


def test_cuts_are_least(monkeypatch):
    rnd = random.Random(2)
    for _ in range(200):
        n = rnd.randint(1, 8)
        gain, ties = [rnd.uniform(-2, 2) for _ in range(n)], [(i, j, rnd.uniform(0, 1.5)) for i in range(n) for j in range(i) if rnd.random() < 0.5]
        price = lambda label: sum(-g for g, k in zip(gain, label) if k) + sum(w for i, j, w in ties if label[i] != label[j])
        assert math.isclose(min(price([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n)), price(mincut_html.min_cut(gain, ties)), abs_tol=1e-9)
