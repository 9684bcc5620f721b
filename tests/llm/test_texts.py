"""Token counts, packing, quality statistics, licenses and language ID against plain Python."""

import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from candor.llm import bpe, langid, licenses, packing, quality, tokens
from candor.llm.words import utf8

SCHEMA = "doc_id long, text string, lang string, task string, band int, language string, rest string, begin long"
ODD = [None, "", " ", "\n\n", "a", "x  y  z", "don't  stop\n\n  x\t\ty ", "日本語 テスト", "word " * 3000, "1 2  3", "\x85 \x1f z", "é" * 50, "hello <|endoftext|> world", "<|endoftext|><|endoftext|>\n\n a<|endoftext|>b <|endoftext|", "x  <|endoftext|>  "]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def frame(spark, texts, langs=None):
    rows = [(k, t, langs[k] if langs else None, "t", 1, "l", "r", 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [(None, "no id", None, "t", 1, "l", "r", 2)], SCHEMA)


def test_ids_equal_the_library(reference):
    data, offs = utf8(pa.array(ODD))
    ids, row = bpe.encoded(bpe.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json")), data, offs)
    for k, t in enumerate(ODD):
        assert ids[row[k] : row[k + 1]].tolist() == reference(t), repr(t)


def test_cache_is_bounded(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    enc = bpe.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(30):
        text = " ".join(f"w{k}x{j}" for j in range(15))
        data, offs = utf8(pa.array([text]))
        ids, _ = bpe.encoded(enc, data, offs)
        assert ids.tolist() == reference(text) and len(enc.known) <= 20


def test_special_tokens_as_text():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    data, offs = utf8(pa.array(ODD))
    ids, row = bpe.encoded(bpe.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"), special=False), data, offs)
    for k, text in enumerate(ODD):
        assert ids[row[k] : row[k + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_edits_count_as_whole_text(reference, monkeypatch):
    encode = bpe.encode_with(bpe.encoder(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "!", "é", "12", "'s", "\t", " ", "don", "<|endoftext|>", "<|endof", "text|>"]
    for trial in range(300):
        monkeypatch.setattr(tokens, "LEAF", rng.choice([1, 2, 8]))
        monkeypatch.setattr(tokens, "FANOUT", rng.choice([4, 5, 16]))
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        tree = tokens.TokenTree(text, encode)
        for _ in range(8):
            at, gone, new = rng.randint(-2, len(text) + 3), rng.choice([-1, 0, 3, 9, 200]), "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 4, 60])))
            a = min(max(at, 0), len(text))
            text = text[:a] + new + text[a + max(gone, 0) :]
            tree.edit(at, gone, new)
            assert tree.text == text and tree.total == len(reference(text)), trial
            assert tree.root.chars == len(text)


def test_an_insertion_updates_one_path():
    encode = bpe.encode_with(bpe.encoder(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(2)
    tree = tokens.TokenTree(" ".join(f"word{k % 97}" for k in range(20_000)), encode)
    most, before = 0, 0
    for _ in range(400):
        seen, chars = tree.summed, tree.encoded
        tree.edit(rng.randint(0, 3000), 0, " a few more words put in here")
        most, before = max(most, tree.summed - seen), max(before, tree.encoded - chars)
    assert most < 40 and before < 3 * 2 * tokens.LEAF * 8
    assert tree.total == len(encode(tree.text))


def test_count_tokens(spark, reference):
    docs = frame(spark, ODD).withColumn("edits", F.expr("array(named_struct('at', 3L, 'remove', 2L, 'insert', ' new word'), null, named_struct('at', cast(null as long), 'remove', 1L, 'insert', cast(null as string)))"))
    got = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    for k, t in enumerate(ODD):
        t = t or ""
        assert got[k].n_tokens == len(reference(t))
        assert got[k].n_tokens_edited == len(reference(t[:3] + " new word" + t[5:])), repr(t)
        assert got[k].n_edits == 1
    long = max(ODD, key=lambda t: len(t or ""))
    assert got[ODD.index(long)].n_chars_encoded < len(long) / 4
    assert tokens.count_tokens(docs.limit(0)).count() == 0 and None in got


def test_packing(spark, reference):
    docs = frame(spark, ODD).repartition(3)
    pieces = [r.asDict() for r in packing.pack_documents(docs, size=64, ids=True).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        assert p["crosses"] == (p["length"] < p["doc_tokens"])
    for k, t in [*enumerate(ODD), (None, "no id")]:
        ps = sorted(by_doc[k], key=lambda p: p["start"])
        whole = np.frombuffer(b"".join(p["ids"] for p in ps), "<u4").tolist()
        assert whole == [*reference(t), 1] and ps[0]["doc_tokens"] == len(whole)
        assert [p["start"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist()
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, ps in by_seq.items():
        ps = sorted(ps, key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == np.cumsum([0, *[p["length"] for p in ps]])[:-1].tolist()
        assert sum(p["length"] for p in ps) == 64 or s == max(by_seq)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_statistics():
    rng = random.Random(2)
    texts = [*ODD, "a b c d e a b c d e", "x\nx\n \nx ", "#a* $%&|<>"] + ["".join(rng.choice(["a", "b", " ", "\n", "é", "#"]) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    data, offs = utf8(pa.array(texts))
    got = quality.statistics(data, offs)
    for k, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert tuple(int(got[c][k]) for c in quality.COUNTS[:5]) == expected, repr(t)


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 2))
    y = ((x[:, 0] + 0.3 * rng.random(3000) < 0.6) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.boost(x[:2000], y[:2000], [-1, 0])
    assert ((trees.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.85
    for other in (0.1, 0.5, 0.9):
        z = trees.score(np.stack([np.linspace(0, 1, 400), np.full(400, other)], 1))
        assert (np.diff(z) <= 1e-12).all()


def test_flattened_trees_equal_a_plain_descent():
    rng = np.random.default_rng(8)
    x = rng.random((1500, 4)).round(2)  # ties with cuts
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float)
    trees = quality.boost(x[:1000], y[:1000], [1, 0, 0, -1])

    def descend(node: int, row) -> float:
        if trees.feature[node] < 0:
            return trees.value[node]
        return descend(int((trees.left if row[trees.feature[node]] < trees.cut[node] else trees.right)[node]), row)

    want = [trees.base + sum(descend(int(root), row) for root in trees.roots) for row in x]
    assert np.allclose(trees.score(x), want, rtol=0, atol=1e-9)
    assert sum(f >= 0 for f in trees.feature) > len(trees.roots)  # they split


def test_every_identifier_is_told_from_the_others():
    for name in licenses.SPDX:
        assert named(f"/* SPDX-License-Identifier: {name} */ int main") == [f"{name} identifier"], name


def test_quality_rules(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["stone", "river", "cloud", "green", "walks", "near"]) + rng.choice("abcdefgh") for _ in range(60)) for _ in range(120)]
    bad = [" ".join(w + "###" for w in t.split()) for t in good[:60]]
    texts = [*good, *bad, None, "", "few words"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k < 120), None) for k in range(180)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert sum(got[k].kept for k in range(120)) >= 118 and sum(got[k].kept for k in range(120, 180)) <= 3
    assert all(got[k].base_failed and not got[k].kept for k in (180, 181, 182))
    assert all(r.kept == (not r.base_failed) for r in quality.judged(docs, labels.limit(0)).collect())
    assert quality.judged(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables here")
def test_rules_on_labels_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    judged = quality.judged(docs, labels.where(half)).join(labels.where(~half), "doc_id")
    kept = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.1


def test_rules_learn_from_all_labels(spark):
    """Every labelled row counts, and barrier tasks that each have some of the rows find what one task finds with all of them."""
    n = 20_000
    u = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1000))
    counts = {c: u(j) for j, c in enumerate(quality.COUNTS)} | {"n_words": 100 + u(50), "n_repeat_words": F.lit(0), "n_lines": 1 + u(51), "n_letters": 1000 + u(52)}
    measured = spark.range(n).select(F.col("id").alias("doc_id"), *[F.lit(0).cast("long").alias(c) if c == "n_repeat_words" else counts[c].cast("long").alias(c) for c in quality.COUNTS])
    labels = measured.select("doc_id", (F.col("n_symbols") + u(90) / 4 < 600).cast("int").alias("quality"))
    one, several = quality.fit(measured, labels, n_trees=3), quality.fit(measured, labels, per_task=12_000, n_trees=3)
    assert one[2] == several[2] == n
    rows = measured.join(labels, "doc_id").where("doc_id < 2000").toPandas()
    x = quality.features({c: rows[c].to_numpy() for c in quality.COUNTS})
    a, b = one[0].score(x), several[0].score(x)
    assert np.corrcoef(a, b)[0, 1] > 0.98 and abs(one[1] - several[1]) < 0.1
    assert b[rows["quality"] > 0].mean() > b[rows["quality"] == 0].mean() + 0.3


def test_sample_is_bounded(spark, monkeypatch):
    """All languages are learned, rare ones too; the sample grows with them up to a bound that raises."""
    rows = [(1, "the river and the house", "en")] * 500 + [(k, f"der fluss {k}", f"l{k % 110}") for k in range(3, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, sample=200)
    assert set(model.langs) == {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert len(model.langs) > 100
    monkeypatch.setattr(langid, "MOST", 50)
    with pytest.raises(ValueError):
        langid.fit(docs, sample=200)


def test_alignment_equals_full_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 5) for _ in range(rng.randint(1, n))], np.uint64) for n in (9, 14))
        full = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                full[i + 1, j + 1] = max(full[i, j + 1], full[i + 1, j], full[i, j] + (a[i] == b[j]))
        pairs = licenses.align(a, b, -20, 20)
        assert len(pairs) == full[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < t for (p, r), (q, t) in zip(pairs, pairs[1:], strict=False))
        assert all(-2 <= j - i <= 3 for i, j in licenses.align(a, b, -2, 3))


def test_winnowing_keeps_one_of_each_span():
    g = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = set(licenses.winnow(g, 4).tolist())
    assert all(kept & set(range(i, i + 4)) for i in range(len(g) - 3))


def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = [
        "x All rights reserved. All rights reserved! y",
        f"Copyright me. {mit.replace('furnished', 'CHANGED twice')} end",
        "nothing here at all",
        "licensed UNDER the apache-license version: 2.0",
        None,
        "",
    ]
    got = [(r.doc_id, r.license, r.matched, r.matched_text) for r in licenses.scan_licenses(frame(spark, texts)).collect()]
    n = len(re.findall(r"[A-Za-z0-9]+", mit))
    assert sorted(g[:3] for g in got) == [(0, "All rights reserved", 3)] * 2 + [(1, "MIT", n - 1), (3, "Apache-2.0 line", 8)]
    assert next(g[3] for g in got if g[0] == 3) == "licensed UNDER the apache-license version: 2.0"
    assert licenses.scan_licenses(frame(spark, texts), {}).count() == 0
    assert licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0


def named(text, templates=None):
    ix = licenses.index(licenses.TEMPLATES if templates is None else templates)
    data, offs = utf8(pa.array([text]))
    return [ix.names[m.template] for m in licenses.matches(licenses._words(data, offs)[3], ix)]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the BSD License.", ["BSD line"]),
        ("Released under the Apache License.", ["Apache line"]),
        ("Released under the Foo License.", []),
        ("Released under a MIT License.", ["MIT line"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0 line"]),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0 line"]),
        ("Licensed under CC BY-XX 4.0.", []),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0 line"]),
        (licenses.TEMPLATES["GPL-3.0 notice"].replace("version 3", "version 2"), []),
        ("Copyright (c) 2020, Me. All rights reserved.\n" + licenses.TEMPLATES["BSD-3-Clause"].replace("the copyright holder nor", "ACME Corp nor"), ["All rights reserved", "BSD-3-Clause"]),
        (licenses.TEMPLATES["BSD-2-Clause"], ["BSD-2-Clause"]),
        (licenses.TEMPLATES["ISC"].replace("AUTHOR", "OWNER"), ["ISC"]),
        (licenses.TEMPLATES["Apache-2.0 notice"], ["Apache-2.0 notice"]),
        ("// SPDX-License-Identifier: Apache-2.0\n", ["Apache-2.0 identifier"]),
        ("SPDX-License-Identifier: Apache-1.1", ["Apache-1.1 identifier"]),
        ("# SPDX-License-Identifier: MIT\n", ["MIT identifier"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later identifier"]),
        ("SPDX-License-Identifier: LGPL-3.0-only", ["LGPL-3.0-only identifier"]),
        ("SPDX-License-Identifier: Foo-9.1", []),
    ],
)
def test_the_right_license_is_named(text, names):
    assert named("Some words before. " + text + " And some after.") == names


def test_short_templates():
    templates = {"one": "Copyleft", "two": "Public domain", "none": "--"}
    assert named("it is copyleft, in the public domain; domain public", templates) == ["one", "two"]


@pytest.mark.parametrize("line", ["Released under the BSD License. ", "under the ", "All rights reserved. ", licenses.TEMPLATES["BSD-2-Clause"][:700]])
def test_repeats_take_time_in_proportion(line):
    began = time.perf_counter()
    named(line * (1_000_000 // len(line)))
    assert time.perf_counter() - began < 15


def test_scan_equals_all_windows():
    """Every stretch of a text against every template: a template is found where it can be found at all."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(40)]
    templates = {f"t{k}": " ".join(rng.choice(words) for _ in range(n)) for k, n in enumerate((5, 7, 9, 14, 20, 30))}
    templates["t6"] = templates["t3"].rsplit(" ", 1)[0] + " other"
    ix = licenses.index(templates)
    hits = 0
    for _ in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        some = templates[rng.choice(list(templates))].split()
        for _ in range(rng.randint(0, len(some) // 4)):
            some[rng.randrange(len(some))] = rng.choice([rng.choice(words), "changed"])
        at = rng.randint(0, len(text))
        data, offs = utf8(pa.array([" ".join(text[:at] + some + text[at:])]))
        h = licenses._words(data, offs)[3]
        expected = set()
        for t, own in enumerate(ix.words):
            for start in range(len(h)):
                pairs = licenses.align(own, h[start : start + len(own) + licenses.BAND], -len(h), len(h))
                if len(pairs) >= 0.8 * len(own) and licenses.told(ix, t, pairs, 0.8):
                    expected.add(t)
        found = {m.template for m in licenses.matches(h, ix)}
        assert found <= expected
        # a template that isn't reported overlaps one with as many words or more
        most = max((int(0.8 * len(ix.words[t])) for t in expected - found), default=0)
        assert not expected or found, (expected, found)
        assert not most or max(len(m.places) for m in licenses.matches(h, ix)) >= most
        hits += bool(found)
    assert hits > 75


def test_edited_copy_before_a_whole_one(spark):
    line = "Licensed under the Apache License, Version 2.0."
    texts = [f"{line[:-3]} {line}", f"{line} {line[:-3]} {line} {line[:-3]}", f"{line[:-3]} x {line[:-3]} {line} end"]
    got = [(r.doc_id, r.start_word, r.matched) for r in licenses.scan_licenses(frame(spark, texts), {"line": line}).collect()]
    assert sorted(got) == [(0, 0, 7), (0, 7, 8), (1, 0, 8), (1, 8, 7), (1, 15, 8), (1, 23, 7), (2, 0, 7), (2, 8, 7), (2, 15, 8)]


def test_language(spark):
    rng = random.Random(5)
    made = {"en": ["the", "and", "river", "with", "house"], "de": ["der", "und", "für", "haus", "straße"], "fr": ["le", "été", "avec", "rivière", "où"]}
    texts, langs = [], []
    for lang, words in made.items():
        for _ in range(80):
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))))
            langs.append(lang)
    n = len(texts)
    texts += [None, "", "123 !!", "日本"]
    langs += [None] * 4
    docs = frame(spark, texts, langs)
    out = langid.identify(docs)
    assert out.columns == [*docs.columns, "language_"]
    rows = out.select("doc_id", "language_.*", langid.held_out(F.col("doc_id")).alias("held_out")).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    held = [k for k in range(n) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert [k for k in got if k is not None and got[k].held_out and k < n] == held
    assert np.mean([got[k].lang_pred == langs[k] for k in held]) > 0.97
    assert all(got[k].lang_pred == "und" and got[k].rejected and got[k].score == 0 for k in (n, n + 1, n + 2))
    assert got[n + 3].lang_pred in made and all(0 <= r.score <= 1 for r in rows)
    assert sum(got[k].rejected for k in range(n)) <= 1
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("language_.lang_pred").distinct().collect()
    assert [r.lang_pred for r in none] == ["und"]
    assert langid.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("learned", [["en", "de"], ["en"]])
def test_foreign_texts_are_rejected(spark, learned):
    rng = random.Random(6)
    made = {"en": ["the", "and", "river", "with", "house"], "de": ["der", "und", "für", "haus", "müller"], "pl": ["jest", "nie", "że", "książka", "wczoraj"]}
    some = lambda lang: " ".join(rng.choice(made[lang]) for _ in range(rng.randint(5, 60)))
    texts, langs = zip(*[(some(k), k) for k in learned for _ in range(120)], strict=True)
    both = [some(learned[0]) + " " + some(learned[-1]) for _ in range(20)]
    both += [some(learned[-1]).upper() for _ in range(10)] + [" ".join([rng.choice(made[learned[-1]])] * 300) for _ in range(10)]
    docs = frame(spark, [*texts, *both, *[some("pl") for _ in range(40)]], [*langs, *[None] * 80])
    got = {r.doc_id: r.rejected for r in langid.identify(docs).select("doc_id", "language_.rejected").collect()}
    n = len(texts)
    assert sum(got[k] for k in range(n)) <= 1 and sum(got[n + k] for k in range(40)) <= 2
    assert sum(got[n + 40 + k] for k in range(40)) >= 38
