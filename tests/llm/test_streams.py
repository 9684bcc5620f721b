"""Streaming BPE, spelling variants and the Merkle manifest against the library and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candor.llm import merkle, spelling, transducer

PATH = public_tokenizers.path(transducer.DEFAULT)
PARTS = ["a", "the", " ", "  ", "\n", "!", "é", "12", "'s", "'r", "e", "'", "\t", "ll", "<|endoftext|>", "<|endof", "text|>", "é", "́", "̧", "Σ", "σ", "日本", "가", "ᅡ", "ᆨ", "ᄀ", "\xa0", "\x1c", "　", "İ", "ß", "😀", "_", "...", "exhilar", "ating", "x" * 30, "!" * 40, "12345", "ͅ", "ΑΣ", "It'S"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text, sizes, rng):
    encoder, data, out, at = transducer.Encoder(PATH), text.encode(), [], 0
    while at < len(data):
        n = rng.choice(sizes)
        out.append(encoder.feed(data[at : at + n]))
        at += n
    return np.frombuffer(b"".join([*out, encoder.end()]), "<u4").tolist()


@pytest.mark.parametrize(("block", "unit"), [(64, 8), (4096, 128), (16, 20)])
def test_streamed_ids_and_text_equal_the_library(library, monkeypatch, block, unit):
    monkeypatch.setattr(transducer, "BLOCK", block)
    monkeypatch.setattr(transducer, "UNIT", unit)
    rng = random.Random(block)
    for _ in range(800):
        some = rng.sample(PARTS, rng.randint(1, len(PARTS)))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 80)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(text, [1, 2, 3, 7, 50, 1000], rng) == want, text
        decoder, data = transducer.Decoder(PATH), np.array(want, "<u4").tobytes()
        assert "".join(decoder.feed(data[k : k + 8]) for k in range(0, len(data), 8)) + decoder.end() == library.decode(want, skip_special_tokens=False)


def test_long_words_are_streamed_in_constant_memory(library, monkeypatch):
    monkeypatch.setattr(transducer, "BLOCK", 64)
    rng = random.Random(2)
    words = sorted({w.removesuffix("</w>") for w in transducer.model(PATH).merges.vocab if w.removesuffix("</w>").isalpha() and w.isascii()})
    for k in range(25):
        text = "".join(rng.choice(words) for _ in range(rng.randint(100, 1500))) if k % 5 else rng.choice("ahe!'") * 4000
        assert ids_of(text, [1000, 50, 5000], rng) == library.encode(text, add_special_tokens=False).ids
    stream, most = transducer.PieceStream(transducer.model(PATH).merges), 0
    for _ in range(300):
        stream.feed("".join(rng.choice("abetinoras") for _ in range(100)))
        most = max(most, len(stream.held))
    assert most <= transducer.model(PATH).merges.lookahead + 1 + 64 + 100


def test_lookahead_is_sufficient():
    """Over all words of a small alphabet: tokens that end `lookahead` before the known part's end are those of every longer word."""
    rng = random.Random(3)
    for _ in range(30):
        tokens, merges = ["a", "b"], []
        while len(merges) < 7:
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens:
                tokens.append(x + y)
                merges.append((x, y))
        m = transducer.Merges({t: k for k, t in enumerate(tokens)}, merges)
        for _ in range(60):
            word = [rng.choice("ab") for _ in range(rng.randint(1, 60))]
            whole = m.merge(word[:])
            for n in range(len(word)):
                at = 0
                for j, t in enumerate(m.merge(word[:n])):
                    at += len(t)
                    if at > n - m.lookahead:
                        break
                    assert whole[j] == t
    with pytest.raises(ValueError):
        transducer.Merges({}, [("ab", "a"), ("a", "b")])


def test_merges_by_search_and_by_heap_are_equal(monkeypatch):
    m, rng = transducer.model(PATH).merges, random.Random(4)
    for _ in range(300):
        word = [rng.choice("etaoinsh") for _ in range(rng.randint(0, 32))]
        short = m.merge(word[:])
        with monkeypatch.context() as c:
            c.setattr(transducer, "SHORT", -1)
            assert m.merge(word[:]) == short


def test_cache_is_bounded_and_keeps_what_is_asked_for():
    made = Counter()
    cache = transducer.Cache(lambda k: made.update([k]) or k * 2, 20, 3)
    for k in range(200):
        assert cache["x"] == "xx" and cache[str(k)] == str(k) * 2 and len(cache) + len(cache.old) <= 20
    assert made["x"] == 1 and cache["long"] == "longlong" and "long" not in cache


def test_texts_encode_and_decode(spark, library):
    texts = [None, "", " \n", "Hello   World's é", "a<|endoftext|>B", "word " * 20000, "x" * 70000, "日本 テスト", "same", "same"]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, "no id", 3, 4)], "doc_id long, text string, ids int, `n.tokens` int")
    got = transducer.encode_texts(df, decoded=True)
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in [*enumerate(texts), (None, "no id")]}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = want[r.doc_id]
        blob = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), blob, hashlib.sha256(blob).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.text for r in transducer.decode_ids(got).collect()} == {k: library.decode(i, skip_special_tokens=False) for k, i in want.items()}
    plain = {r.doc_id: r.text for r in transducer.decode_ids(got, plain=True).collect()}
    assert plain[3] == "hello world 's é " and plain[7] == "日本 テスト "
    assert transducer.encode_texts(df.limit(0)).count() == 0


def lower(s):
    return s.translate({c: c + 32 for c in range(65, 91)})


def near_by_force(words):
    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    return {w: [v for v in words if v != w and one_edit(v, w)] for w in words}


def test_spelling_variants_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé÷ÿ") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    texts = []
    for k in range(300):
        words = []
        for _ in range(30):
            w = rng.choice(base[: rng.choice([3, 40])])
            if rng.random() < 0.3:
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice("abé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abcÿ") + w[at + 1 :]])
            words.append(w.title() if rng.random() < 0.1 else w)
        texts.append(rng.choice([" ", "-", "1"]).join(words))
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(900, None, "x", 1, 2), (901, "", "x", 1, 2), (None, texts[0], "x", 1, 2), (3, texts[3], "x", 1, 2), (3, texts[3], "x", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, mask int")
    count = Counter()
    for k, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            count[w] += len(w) >= 5
    n = {w: c for w, c in count.items() if c >= 3}
    near = near_by_force(list(n))
    form = {w: min(v, key=lambda x: (-n[x], x)) if v else None for w, v in near.items()}
    form = {w: f if f and n[f] >= 2 * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_variants(df).collect()}
    assert got == {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}
    assert sum(len(v) for v in near.values()) > 200 and any(form.values())
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_long_chains_end_in_one_root(spark):
    chain = ["a" * (5 + k) for k in range(12)]  # each a letter longer and twice as frequent
    df = spark.createDataFrame([(w, 3 * 2**k) for k, w in enumerate(chain)], "word string, n long")
    got = {r.word: r.root for r in spelling.variants(df).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def digest(parts):
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([digest(x[k : k + arity]) for k in range(0, len(x), arity)])
    return levels


def siblings(levels, j, arity):
    out = []
    for level in levels[:-1]:
        a = j // arity * arity
        run = level[a : a + arity]
        out.append((b"".join(run[: j - a]), b"".join(run[j - a + 1 :])))
        j //= arity
    return out


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_traversal_equals_the_whole_tree(monkeypatch, arity):
    monkeypatch.setattr(merkle, "ARITY", arity)
    for n in [*range(1, 40), 100, 257, 300]:
        leaves = [b"%d" % k for k in range(n)]
        levels = tree(leaves, arity)
        height = merkle.levels_of(n, 99)
        assert height == len(levels) - 1 and merkle.block_root(leaves, height) == levels[-1][0]
        for k, path in enumerate(merkle.paths(leaves, height)):
            assert path == siblings(levels, k, arity)
            assert merkle.fold(leaves[k], path) == levels[-1][0]


@pytest.mark.parametrize("height", [1, 3])
def test_manifest_equals_plain_trees(spark, height):
    rng = random.Random(height)
    rows = []
    for k in range(900):
        source = rng.choice(["hot", "hot", "é", "b", None, "", *(f"s{j}" for j in range(20))])
        rows.append((k, source, rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["A text", "small", "", None, "Ünï"]) , "x", k))
    rows += [(None, "hot", "en", 1, "No id", "x", 1), (None, None, None, None, None, "x", 2), rows[5], rows[5], (7, rows[7][1], "en", 3, "Same id", "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, tree string, place long")
    claimed = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    leaf = lambda *f: digest([b"-" if x is None else b"%d:" % len(str(x).encode()) + str(x).encode() for x in f])
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        of[s].sort(key=lambda x: x[:3])
    trees = {s: tree([x[2] for x in of[s]], 16) for s in names}
    top = tree([trees[s][-1][0] for s in names], 16)
    root = top[-1][0].decode()
    expected = Counter()
    for j, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(of[s]):
            path = siblings(trees[s], k, 16) + siblings(top, j, 16)
            text = r[4].lower() if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r[4]
            folded = merkle.fold(leaf(*r[:4], text), path).decode()
            expected[r[0], own.decode(), trees[s][-1][0].decode(), root, digest([x for p in path for x in p]).decode(), folded, folded == root] += 1
    out = merkle.manifest(df, claimed, path=True, height=height).collect()
    assert Counter(tuple(r)[:7] for r in out) == expected and {r.verified for r in out} == {True, False}
    for r in out[:50]:
        assert merkle.fold(r.leaf.encode(), [(bytes(p.left), bytes(p.right)) for p in r.path]).decode() == root
    assert merkle.manifest(df.limit(0)).count() == 0
    alone = merkle.manifest(df.limit(1)).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == hashlib.sha256(b"").hexdigest()
