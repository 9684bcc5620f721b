"""Near duplicates, repeated passages, contamination, archives, pages and the pipeline against brute force."""

import hashlib
import html as htmllib
import os
import random
import re
import struct
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from candor.llm import decontam, htmltext, neardup, substring, warc

SCHEMA = "doc_id long, text string, chunk string, band int, row int, node long, sha string, segment int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, 2, 3, "s", 4) for i, t in rows], SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = []
    for _ in range(25):
        base = sentence(rng, rng.randint(3, 150))
        rows += [base] * rng.randint(1, 3)
        rows += [edited(rng, base, rng.randint(1, 4)) for _ in range(rng.randint(0, 4))]
    cloud = sentence(rng, 150)  # a large group of near copies, linked through each other
    rows += [edited(rng, cloud, rng.randint(1, 6)) for _ in range(60)]
    rows += ["", "", "one", "one", "two words"]
    rows += [sentence(rng, 40) + " is one." * 60 for _ in range(4)]  # much repeated, but not alike
    rng.shuffle(rows)
    return [*enumerate(rows), (len(rows), None), (len(rows) + 1, None), (3, rows[3]), (None, rows[0]), (5, rows[9]), (11, edited(rng, rows[30] + " " + rows[31], 1)), (12, rows[30] + " " + rows[31])]


def test_near_duplicates(spark, corpus):
    docs = frame(spark, corpus)
    got = [(r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()]
    assert Counter(g[0] for g in got) == Counter(c[0] for c in corpus)
    texts = {t for i, t in corpus if t is not None and i is not None}
    rows = len(corpus)
    df = Counter(s for _, t in corpus if t is not None for s in shingles(t))
    weight = {t: {s: (1 + np.log(n)) * (1 + neardup.DAMPING * np.log(min(max(rows / df[s], 1), neardup.RARE)) / np.log(neardup.RARE)) for s, n in shingles(t).items()} for t in texts}
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    order = sorted(texts)
    for k, a in enumerate(order):
        for b in order[:k]:
            both = sum(min(w, weight[b].get(s, 0)) for s, w in weight[a].items())
            either = sum(weight[a].values()) + sum(weight[b].values()) - both
            if both and both >= 0.8 * either - 1e-6:
                parent[root(a)] = root(b)
    one = {}
    for i, t in corpus:
        if t is not None and i is not None:
            parent[root(one.setdefault(i, t))] = root(t)
    expected = defaultdict(list)
    for i, t in corpus:
        if t is not None and i is not None:
            expected[root(t)].append(i)
    classes = {i: min(ids) for ids in expected.values() for i in ids}
    wrong = [g for g in got if g[0] is not None and g[1] != classes.get(g[0], g[0])]
    assert not wrong
    assert (None, None) in got
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_find_every_link(spark, corpus, monkeypatch):
    docs = frame(spark, corpus)
    whole = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 700)  # the cloud's buckets are split
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == whole


def test_samples_agree_with_similarity():
    rng = np.random.default_rng(3)
    x = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    w = np.ones(400, np.float32)
    half = w.copy()
    half[::2] = 2
    pairs = [(x[:300], x[100:], w[:300], w[:300], 0.5), (x, x, w, half, 400 / 600)]
    for a, b, wa, wb, similarity in pairs:
        sig = neardup.samples(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, len(a), len(a) + len(b)]), neardup.BANDS * neardup.ROWS)
        assert abs((sig[:, 0] == sig[:, 1]).mean() - similarity) < 0.2


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.class_id for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    find = lambda v: v if parent.setdefault(v, v) == v else find(parent[v])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_substring_dedup(spark):
    rng = random.Random(8)
    shared = [sentence(rng, n) for n in (13, 14, 40, 12)]
    rows = []
    for k in range(120):
        parts = [sentence(rng, rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), sentence(rng, rng.randint(0, 20))]
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(k + 500, rows[k][1]) for k in range(5)] + [(1000, None), (1001, ""), (7, rows[7][1]), (None, shared[2]), (1002, "x " * 500)]
    docs = frame(spark, rows)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    expected = []
    for (i, t), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - 12) if i is not None and least[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else t))
    got = substring.remove_repeats(docs, rest=["chunk", "row"])
    rows_got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got.collect()]
    assert sorted(rows_got, key=repr) == sorted(expected, key=repr)
    assert got.select("rest.chunk", "rest.row").distinct().count() == 1
    assert sum(e[2] for e in expected) > 500
    shuffled = substring.remove_repeats(docs.repartition(5, "text"), text=False)  # written first, as its order isn't fixed
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in shuffled.collect() if r.doc_id is not None) == sorted(e[:4] for e in expected if e[0] is not None)
    assert substring.remove_repeats(docs.limit(0)).count() == 0
    few = frame(spark, [(1, "a few words"), (2, None), (3, ""), (4, "a few words")])  # no window at all
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(few).collect()) == [(1, 3, 0), (2, 0, 0), (3, 0, 0), (4, 3, 0)]


def brute_contamination(docs, items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[key]
        names = sorted((str(x) for x in found if x is not None), key=str.encode)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontam.BLOCK_PHRASES, 40])
def test_contamination(spark, monkeypatch, block):
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.choice([3, 12, 13, 14, 30]))) for k in range(25)]
    items += [(100, None), (101, ""), (102, "--- !!"), (None, sentence(rng, 20)), (1, items[1][1]), (103, items[4][1])]
    docs = []
    for k in range(150):
        text = sentence(rng, rng.randint(0, 200))
        if rng.random() < 0.5 and (t := rng.choice(items)[1]):
            text += " " + t.upper().replace(" ", ", ") + ". " + sentence(rng, rng.randint(0, 5))
        docs.append((k, text))
    docs += [(900, None), (901, ""), (902, "-- !"), (3, docs[3][1]), (None, docs[4][1]), (903, "é ".join(items[5][1].split(" ")))]
    monkeypatch.setattr(decontam, "BLOCK_PHRASES", block)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, segment int")
    got = sorted((tuple(r) for r in decontam.contamination(frame(spark, docs), bench).collect()), key=repr)
    assert got == brute_contamination(docs, items)
    assert sum(g[5] for g in got) > 20
    if block > 40:
        assert not any(r.contaminated for r in decontam.contamination(frame(spark, docs), bench.limit(0)).collect())
        assert decontam.contamination(frame(spark, docs).limit(0), bench).count() == 0


def test_dealt_phrases_find_what_sent_ones_do(spark, monkeypatch):
    rng = random.Random(21)
    items = [(f"i{k}", " ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 3, 5, 9])))) for k in range(60)]
    items += [(f"same{k}", "a line that stands in many items") for k in range(50)] + [(None, "g f e"), ("none", None), ("rare", "zzz yyy")]
    docs = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60)))) for k in range(80)]
    docs += [(900, None), (901, ""), (902, "So, a line that stands in many items."), (3, docs[3][1]), (None, "g f e"), (903, "zzz"), (904, "yyy")]
    index = decontam.index(frame(spark, docs).repartition(6))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = []
    for most, dealt in ((decontam.BLOCK_PHRASES, decontam.DEALT), (10, 7)):
        monkeypatch.setattr(decontam, "BLOCK_PHRASES", most)
        monkeypatch.setattr(decontam, "DEALT", dealt)
        rows = decontam.search(index, bench, 3).collect()
        found.append(sorted((r.segment, r.row, repr(r.doc_id), r.n_words, bytes(r.spans or b""), tuple(sorted(r["items"]))) for r in rows))
    assert found[0] == found[1] and len(found[0]) == len(docs)
    assert max(len(r[5]) for r in found[0]) >= 50 and any(r[4] for r in found[0])
    assert not any("rare" in r[5] for r in found[0])


def test_proximity():
    texts = ["a b c d e f g h", "a x x x x x x b", "b a"]
    import pyarrow as pa

    data, offs = decontam.utf8(pa.array(texts))
    ids, first, terms, counts, positions = decontam._segment([0, 1, 2], data, offs)
    p = decontam.Postings({"doc_ids": ids, "first": first, "terms": terms, "counts": counts, "positions": positions})
    words = decontam.term_hashes(*decontam.utf8(pa.array(["a b"])))[0]
    assert [int(np.searchsorted(p.first, at, "right") - 1) for at in p.near(words, 2)] == [0, 2]
    assert len(p.near(decontam.term_hashes(*decontam.utf8(pa.array(["a zz"])))[0], 9)) == 0


def test_proximity_over_the_index(spark, monkeypatch):
    rng = random.Random(14)
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 300)
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(None, "a b"), (61, None), (62, "H, G!")]
    index = decontam.index(frame(spark, docs))
    assert index.count() > 3
    for within in (0, 1, 4):
        got = defaultdict(set)
        for r in decontam.proximity(index, ["a b", "G h c", "a", "a zz", "", "a b"], within).collect():
            assert r.position not in got[r.terms, r.doc_id]
            got[r.terms, r.doc_id].add(r.position)
        for terms in ("a b", "G h c", "a", "a zz", ""):
            for k, t in docs:
                w, want = re.findall("[a-z]+", (t or "").lower()), terms.lower().split()
                around = {x: {i for i in range(len(w)) if w[i] == x and all(y in w[max(0, i - within) : i + within + 1] for y in want)} for x in want}
                assert got[terms, k] in (list(around.values()) or [set()]), (terms, k)


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(10)
    pages = [(k, f"http://h.example/{k}?q=a b\r\nX: y", "<p>" + sentence(rng, 400)) for k in range(40)]
    pages += [(50 + k, None, pages[3][2]) for k in range(30)] + [(90, "u", None), (91, "u", ""), (92, "u", "é" * 3), (92, "u", "é" * 3), (None, "u", "é" * 3)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, latest string").repartition(3)
    index = warc.write(df, root=str(tmp_path / "bundles"))
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect() if r.page_id is not None)
    latest = {}
    for i, _, h in pages:
        latest[h or ""] = max(latest.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in pages:
        if i is not None:
            raw, last = (h or "").encode(), latest[h or ""]
            expected.append((i, len(raw), warc.digest_of(raw), "response" if i == last else "revisit", None if i == last else last))
    assert [g[:4] for g in got] == [e[:4] for e in sorted(expected, key=repr)] or sorted(got, key=repr) == sorted(expected, key=repr)
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    payload = {r.page_id: bytes(r.payload) for r in warc.read(index).where("record_type = 'response'").collect()}
    assert payload[0].decode() == pages[0][2]
    # any Zstandard reader unpacks a whole bundle, and the seek table matches its frames
    file = next((tmp_path / "bundles").glob("*.warc.zst")).read_bytes()
    n, _, magic = struct.unpack("<IBI", file[-9:])
    sizes = list(struct.iter_unpack("<II", file[-9 - 8 * n : -9]))
    assert magic == 0x8F92EAB1 and sum(a for a, _ in sizes) + 8 + 8 * n + 9 == len(file)
    whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert len(whole) == sum(b for _, b in sizes) and whole.startswith(b"WARC/1.1\r\n")
    assert warc.read(warc.write(df.limit(0), root=str(tmp_path / "none"))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Menu {n}</a></ul></nav><!-- <p>no</p> --><div class="box">Site line</div><div class="ad">Buy {n}</div>
<article><h1>Title &amp; {n}</h1><p><b>First  part<br>goes&nbsp;on<p>Second &lt;b&gt; para {n}<form><input value="no">Send</form>
<aside>Side</aside><ul><li>one<li>two</ul><div id="comments"><p>Reader says</p></div></article><footer>&copy; me {n}</footer></body></html>"""
TEXT = "Title & {n}\n\nFirst part goes on\n\nSecond <b> para {n}\n\none\n\ntwo"


def test_main_text():
    assert htmltext.main_text(PAGE.replace("{n}", "7")) == TEXT.replace("{n}", "7")
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p>") == ""
    assert htmltext.main_text("plain &amp; text") == "plain & text"
    assert htmltext.main_text("<div>a</div>b<div>c <span>d</span>e</div>") == "a\n\nb\n\nc de"
    assert htmltext.main_text("<article><figure><img><figcaption>Caption</figcaption></figure><p>x <math><mi>y</mi></math></article>") == "Caption\n\nx y"
    assert htmltext.main_text("<p>cut off <b") == "cut off <b"
    assert htmltext.main_text("<div>" * 5000 + "deep") == "deep"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="with-sidebar"><article><p>Text</p></article></div>', "Text"),
        ('<div class="content no-sidebar"><p>Text</p></div>', "Text"),
        ("<form id=aspnetForm><div><p>Text</p></div></form>", "Text"),
        ('<article><p class="social-history">Text</p></article>', "Text"),
        ('<article><h2 class="section-header">Head</h2><p>Text and more</p></article>', "Head\n\nText and more"),
        ('<div class="page-header"><article><p>Text</p></article></div>', "Text"),
        ('<article><p>Body</p><textarea>left open <p>Rest</p></article>', "Body\n\nleft open\n\nRest"),
        ('<p title="abc>Text</p>', "Text"),
        ("<p>a < b and c <d e='>'>f</p>", "a < b and c f"),
        ('<body><div class="siteFooter"><p>No</p></div><div id="main-nav">No</div><p>Main words here</p><div hidden><p>No</p></div></body>', "Main words here"),
        ('<article><p>Own text of the page</p><div class="social-share"><p>Share</p></div><form><p>Write to us</p><input></form></article>', "Own text of the page"),
        ('<article><p>Own text</p></article><div class="sidebar"><article><p>Other</p></article></div>', "Own text"),
        ("<article><p>Short.</p></article><section id='comments'><h2>Comments</h2>" + "<article><p>A remark of some length here</p></article>" * 9 + "</section>", "Short."),
        ("<article><p>Short.</p><div class='comments'><h2>Comments</h2>" + "<p>A remark of some length here</p>" * 9 + "</div></article>", "Short."),
        ("<div><p>Short.</p></div><div class='comment-list'><h2>Comments</h2>" + "<p>A remark of some length here</p>" * 9 + "</div>", "Short."),
        ("<article><p>Short.</p></article><ol class='commentlist'>" + "<li><p>A remark of some length here</p>" * 9 + "</ol>", "Short."),
        ("<article><p>Main text, a good length of it.</p></article><div class='more-stories'>" + "<article><p>Another story of the site</p></article>" * 5 + "</div>", "Main text, a good length of it."),
        ("<article><p>Main text.</p><div class='newsletter-cta'><p>Get all of our news in your mail, every day of the week</p></div></article>", "Main text."),
        ("<article><p>Main text.</p><form action=x><p>Write to us, in as many words as you like, by this form</p></form></article>", "Main text."),
        ("<article><h1>Story</h1><p>A text of some fifty characters, that is the story.</p></article><article><p>Teaser</p></article>", "Story\n\nA text of some fifty characters, that is the story."),
        ("<article><p>First of two parts</p></article><article><p>Second of two parts</p></article>", "First of two parts\n\nSecond of two parts"),
        ('<div class="more"><p>The rest of it</p></div>', "The rest of it"),
        ('<div id="content"><p>Main text of the page</p></div><div class="sidebar"><article><p>Teaser</p></article></div>', "Main text of the page"),
        ('<body class="comments"><p>Text</p></body>', "Text"),
    ],
)
def test_names_never_cost_the_text(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<a<a", '<a x="', "<textarea>", "<!--", "<p title='", "<td><p>", "<b>", "<b><div></i>"])
def test_long_broken_pages_take_time_in_proportion(part):
    def took(n):
        began = time.perf_counter()
        htmltext.main_text("<p>x</p>" + part * (n // len(part)))
        return time.perf_counter() - began

    took(10_000)
    assert took(400_000) < max(1.0, 40 * took(50_000))


def test_subtree_counts_equal_a_plain_count(spark):
    rng = random.Random(15)
    some = ["<div><p>Salt</p></div>", "<p>Follow us</p>", "<nav><a>Menu</a></nav>", "<div class=box>Line</div>", "<ul><li>one</li></ul>"]
    rows = []
    for k in range(80):
        outside, inside = (" ".join(rng.choice(some) for _ in range(rng.randint(0, 4))) for _ in range(2))
        rows.append((k, f"http://{rng.choice('ab')}.example/{k}", f"<body>{outside}<article><p>{rng.randint(0, 30)}</p>{inside}</article></body>"))
    outer, inner, articles, pages = Counter(), defaultdict(set), defaultdict(set), Counter()
    for _, url, page in rows:
        where = url[7:16]
        root = htmltext.parse(page)
        out, within = htmltext.hashes(root, htmltext.mains(root))
        pages[where] += 1
        outer.update((where, h) for h in out)
        for own, found in within.items():
            articles[where].add(own)
            for h in found:
                inner[where, h].add(own)
    expected = defaultdict(set)
    for (where, h), n in outer.items():
        if n >= 5 and n >= 0.2 * pages[where]:
            expected[where].add(htmltext._signed(h))
    for (where, h), of in inner.items():
        if len(of) >= 5 and len(of) >= 0.2 * len(articles[where]):
            expected[where].add(htmltext._signed(h))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).withColumn("host", htmltext.host(F.col("url")))
    got = {r.host: set(r.subtrees) for r in htmltext.templates(df).collect()}
    assert got == expected and all(len(v) > 2 for v in got.values())


def test_site_templates(spark):
    own = "<body><div class=box><p>Site line</p><p>More</p></div><div>Own text {n}</div><p>Twice</p></body>"
    rows = [(k, f"http://Site.example:80/{k}", own.replace("{n}", str(k))) for k in range(30)]
    rows += [(100 + k, f"http://copies.example/{k}", PAGE.replace("{n}", "1")) for k in range(20)]  # copies of an article stay whole
    rows += [(200, None, "<p>no host</p>"), (201, "x", None), (202, "http://few.example/", own)]
    df = spark.createDataFrame([(*r, "h", [1]) for r in rows], "page_id long, url string, html string, host string, subtrees array<int>")
    got = {r.page_id: r for r in htmltext.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[k].text == f"Own text {k}" for k in range(30))
    assert all(got[100 + k].text == TEXT.replace("{n}", "1") for k in range(20))
    assert got[200].text == "no host" and (got[201].text, got[201].n_chars) == ("", 0)
    assert got[202].text == "Site line\n\nMore\n\nOwn text {n}\n\nTwice"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert htmltext.extract(df.limit(0)).count() == 0


def test_templates_within_articles(spark):
    page = "<body><nav>Menu</nav><article><h1>Title {n}</h1><p>Own <b>very</b> text {n}</p><div class=box><p>Read our letter</p></div><ul><li>Salt</li><li>Item {n}</li></ul><table><tr><td>0</td><td>{n}</td></tr></table><p>Follow <i>us</i></p><a>More</a></article></body>"
    text = "Title {n}\n\nOwn very text {n}\n\nSalt\n\nItem {n}\n\n0\n\n{n}"
    near = "<article><h1>News</h1>" + "".join(f"<p>Paragraph {k} of a longer piece that sites copy</p>" for k in range(6)) + "<p>Seen {n} times</p></article>"
    main = "<body><main><p>Text {n}</p><p>Share this</p></main></body>"
    rows = [(k, f"http://site.example/{k}", page.replace("{n}", str(k))) for k in range(30)]
    rows += [(100 + k, f"http://copies.example/{k}", page.replace("{n}", "1")) for k in range(20)]
    rows += [(200 + k, f"http://near.example/{k}", near.replace("{n}", str(k))) for k in range(20)]
    rows += [(300 + k, f"http://main.example/{k}", main.replace("{n}", str(k))) for k in range(20)]
    rows += [(400 + k, f"http://both.example/{k}", page.replace("{n}", str(max(k, 10)))) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert [got[k] for k in range(30)] == [text.replace("{n}", str(k)) for k in range(30)]
    assert all(got[100 + k] == htmltext.main_text(rows[30][2]) for k in range(20))  # one article, copied
    assert all(got[200 + k].split("\n\n") == ["News", *[f"Paragraph {j} of a longer piece that sites copy" for j in range(6)], f"Seen {k} times"] for k in range(20))
    assert all(got[300 + k] == f"Text {k}" for k in range(20))
    assert all("Read our letter" not in got[400 + k] and "Own very text" in got[400 + k] for k in range(30))


def test_references_are_decoded_once():
    for s in ("&amp;lt;", "&eacute;&#233;&#xE9;", "&am", "&nope;", "a&nbsp;&nbsp;b"):
        assert htmltext.main_text(f"<p>{s}</p>") == re.sub(r"\s+", " ", htmllib.unescape(s))


def test_pipeline_rows_without_an_id_of_their_own(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    t = [sentence(rng, 120) for _ in range(8)]
    item = sentence(rng, 20)
    rows = [(1, t[0]), (1, t[0]), (2, t[1]), (2, t[2]), (3, t[1]), (None, t[3]), (None, t[3]), (None, t[4]), (9, t[4]), (4, t[5]), (None, t[6]), (5, None), (5, None)]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, t[0]), (2, t[1]), (2, t[2]), (None, t[3]), (9, t[4]), (4, t[5]), (None, t[6]), (5, None), (5, None)], key=repr)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, t[0]), (1, item), (None, item), (None, t[1])]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], docs.schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, t[0]), (None, t[1])], key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    passage, item = sentence(rng, 60), sentence(rng, 20)
    texts = [sentence(rng, 120) for _ in range(60)]
    texts[10] = texts[2]
    texts[11] = edited(rng, texts[3], 2)
    for k in (20, 25):
        texts[k] += " " + passage + " " + sentence(rng, 80)
    texts[30] = item + " " + sentence(rng, 10)
    texts += ["", "12 34 !!", None]
    docs = spark.createDataFrame([(k, t, "en" if t else None, "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in at.collect()}
    everything = set(range(len(texts)))
    assert set(kept["language_id"]) == everything - {60, 61, 62}
    assert set(kept["near_dedup"]) == set(kept["language_id"]) - {10, 11}
    assert set(kept["substring_dedup"]) == set(kept["near_dedup"])
    assert passage in kept["substring_dedup"][20].text and passage.split()[30] not in kept["substring_dedup"][25].text.split()[100:]
    assert kept["substring_dedup"][25].n_chars == len(kept["substring_dedup"][25].text) < len(texts[25])
    assert set(kept["decontamination"]) == set(kept["substring_dedup"]) - {30}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(kept["decontamination"])
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_pipeline_with_other_columns_and_without_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    passage, item = sentence(rng, 40), sentence(rng, 20)
    texts = [sentence(rng, 80) for _ in range(30)]
    texts[4], texts[7] = texts[2], texts[7] + " " + item * 1
    texts[9] += " " + passage
    texts[12] = passage + " " + texts[12]
    schema = "row_key string, doc_id long, text string, lang string, kept string, rest string, chunk int, class_id string, row int, n_chars long, language boolean, other_key map<string,int>, `my col` string, `a.b` int"
    rows = [(f"k{k}", k, t, "en", "K", "R", 7, "c", k, len(t), True, {"m": k}, "mine", k) for k, t in enumerate(texts)] + [("n",) + (None,) * 13]
    rows += [rows[9], rows[20], rows[20]]  # repeated
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{empty}"))
            at = spark.read.parquet(str(tmp_path / f"{name}{empty}"))
        got = {r.doc_id: r for r in at.collect()}
        assert set(got) == (set() if empty else set(range(30)) - {4, 7})
        assert at.count() == len(got)
        assert all((r.row_key, r.kept, r.rest, r.chunk, r.class_id, r.row) == (f"k{k}", "K", "R", 7, "c", k) for k, r in got.items() if k is not None)
        assert all((r["other_key"], r["my col"], r["a.b"]) == ({"m": k}, "mine", k) for k, r in got.items() if k is not None)
        if not empty:
            assert got[12].n_chars == len(got[12].text) < len(texts[12]) and got[9].text == texts[9]
        assert (corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == 0) == empty


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_near_copies_of_the_tables_are_found(spark):
    """Pairs of plain similarity 0.8 or more on five-word shingles, by brute force over common shingles."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {r.doc_id: set(shingles(r.text)) for r in docs.collect()}
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    holders = defaultdict(list)
    for i, some in sets.items():
        for x in some:
            holders[x].append(i)
    pairs = {(a, b) for ids in holders.values() if len(ids) <= 200 for k, a in enumerate(ids) for b in ids[:k]}
    alike = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    found = sum(classes[a] == classes[b] for a, b in alike)
    assert len(alike) > 20 and found >= 0.9 * len(alike)
    linked = defaultdict(set)
    for a, b in alike:
        linked[a].add(b)
        linked[b].add(a)
    sizes = Counter(classes.values())
    # nearly all members of a class have a partner by plain similarity too
    lone = [i for i, c in classes.items() if sizes[c] > 1 and not linked[i]]
    assert len(lone) <= 0.1 * sum(n for n in sizes.values() if n > 1)


def test_rest_imports_without_llm():
    code = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('candor.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, Gone())\nimport candor.plans.queries, candor.sources.corpus\nassert not any('llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(substring.__file__).split("/candor/")[0])
