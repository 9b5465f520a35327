"""Every operator against brute force on a small fixture, and its defined edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import (
    bloom, components, decontaminate, fingerprints, lang_id, mixing, repeats, secret_scan, set_join, token_counts, toxicity, wrappers,
)
from cohortlens.llm.queries import TOKENIZER, TOKENIZER_FOLDER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, copies string, score string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))) + "." for _ in range(40)]
    texts += [texts[1]] * 3 + ["", None, "   \n", "One two", "ONE TWO", "😀", "12 34"]
    for t in texts[:12]:  # near copies and embedded passages
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), "Intro words\n" + t + " tail"]
    texts.append(" ".join(rng.choice(vocab) for _ in range(60_000)))
    texts.append("ab" * 700)  # a periodic text
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s2", "é", None]), 0, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))


def test_language(spark, rows, docs, empty):
    train = spark.createDataFrame([("the cat and the dog and the house", "en"), ("le chat et le chien et la maison", "fr")] * 5, "text string, lang string")
    model = lang_id.fit(train, "text", "lang")
    got = by_id(lang_id.predict(docs.select("doc_id", "text", "score"), model))
    assert got.keys() == {r[0] for r in rows}
    for i, text, *_ in rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert 0 <= got[i].score <= 1
    some = spark.createDataFrame([(1, "The dog and the house"), (2, "et la maison"), (3, None)], "doc_id long, text string")
    assert {k: r.lang_pred for k, r in by_id(lang_id.predict(some, model)).items()} == {1: "en", 2: "fr", 3: "und"}
    assert lang_id.document_languages(empty).count() == 0


def test_bit_sliced_masks_have_no_false_negative(spark):
    train = spark.createDataFrame([(f"{chr(97 + k) * 5} common words here", f"l{k:02}") for k in range(26)] * 2, "text string, lang string")
    model = lang_id.fit(train, "text", "lang", bits=14)
    h, _, _ = lang_id.grams(["common words here"])
    assert all((model.masks(h, 0) & np.uint64(1 << k) != 0).all() for k in range(26))


def test_secrets(rows, docs, empty):
    text = 'x = "Zk39fjQ02mVb81Lx"\npassword = x\nuser: "bob"\n' + "AKIA" + "A1" * 8 + " token='" + "q" * 14 + "' password: token: abcdefghijklmnop"
    spans = secret_scan.scan(text)
    assert [k for k, *_ in spans] == ["named", "access", "assign"]
    a, b = spans[0][1:3]
    assert text[a:b] == "Zk39fjQ02mVb81Lx"
    got = by_id(secret_scan.document_secrets(docs))
    assert len(got) == len(rows) and got[rows[43][0]].spans == ""
    kept = secret_scan.redact_secrets(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert secret_scan.document_secrets(empty).count() == 0
    assert secret_scan.redact("abcdef", [("hex", 1, 3, 1.0), ("hex", 2, 4, 1.0)], "*") == "a*ef"


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><li>menu</li></nav><div class='site-header'>top</div><!-- c -->"
        "<article><h1>Title &amp; more</h1><p>One  two<br>three<p><b>Four</b> <a title='a>b'>five</a></p><div class=\"comments\"><div>me</div>too</div></article>"
        "<aside>side</aside><footer>&copy; x</footer></body></html>"
    )
    assert wrappers.main_text(page) == "Title & more\n\nOne two three\n\nFour five"
    plain = [f"<body><div><i>Buy now</i></div><div><p>{w} first</p><p>{w} second</p></div></body>" for w in ("red", "blue", "green", "grey")]
    wrapper = wrappers.infer([wrappers.skeleton(p) for p in plain])
    assert ")+" in wrapper.pattern() and len(wrapper.template()) == 1
    rows = [(k, f"http://a.example/{k}", p) for k, p in enumerate(plain)] + [(9, None, None), (10, "http://b.example/", ""), (11, "http://b.example/", page)]
    got = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].text == "red first\n\nred second" and got[9].text == "" and got[10].n_chars == 0
    assert got[11].n_chars == len(got[11].text) > 0
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_components(rows):
    sets = {}
    for i, text, *_ in rows:
        w = words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    name = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(len(ids)):
        before = dict(name)
        for a in ids:
            for b in ids:
                if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
        if name == before:
            break
    return {i: (len(sets[i]), name[i]) for i in ids}


@pytest.mark.parametrize("split", [set_join.SPLIT, 2])
def test_ngram_jaccard(rows, docs, empty, split):
    got = by_id(set_join.link_components(docs, split=split))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows)
    if split != 2:
        kept = {r.doc_id for r in set_join.drop_near_duplicates(docs).collect()}
        assert kept == {i for i, (_, c) in brute_components(rows).items() if c == i}
        assert set_join.link_components(empty).count() == 0


def test_split_lists_give_the_same_pairs():
    rng = np.random.default_rng(1)
    e = np.zeros(60, set_join.ENTRY)
    e["h"], e["id"], e["n"] = 5, np.arange(60), 100 + rng.integers(0, 20, 60)
    e["lab"] = e["id"]
    whole = {tuple(p) for p in set_join.list_pairs(e)}
    parts = set()
    k, own = 3, e["id"] % 3
    for i in range(k):
        for j in range(i, k):
            part = e[(own == i) | (own == j)].copy()
            part["part"], part["own"] = (1 + i * k + j if i != j else -1 - i), own[(own == i) | (own == j)]
            parts |= {tuple(p) for p in set_join.list_pairs(set_join.unpack_entries(memoryview(set_join.pack_entries(part))))}
    assert parts == whole and len(whole) > 100


def test_set_join_lists_skip_pairs_of_earlier_shingles():
    rng = np.random.default_rng(5)
    base = np.sort(rng.choice(1 << 47, 60, replace=False)).astype(np.uint64)
    sets = [np.sort(rng.choice(base, 50, replace=False)) for _ in range(25)]
    entries = np.concatenate([np.zeros(30, set_join.ENTRY) for _ in sets])
    for k, s in enumerate(sets):
        e = entries[30 * k : 30 * k + 30]
        e["h"], e["id"], e["lab"], e["n"], e["pos"] = s[:30], k, k, 50, np.arange(30)
        e["seen"] = set_join.seen_before(s[:30])
    lists = [set_join.unpack_entries(memoryview(set_join.pack_entries(entries[entries["h"] == h]))) for h in base]
    found = [[tuple(p) for p in set_join.list_pairs(e)] for e in lists if len(e)]
    bare = entries.copy()
    bare["seen"] = 0
    plain = [[tuple(p) for p in set_join.list_pairs(bare[bare["h"] == h])] for h in base if (bare["h"] == h).any()]
    linked = {(a, b) for a in range(25) for b in range(a + 1, 25) if len(np.intersect1d(sets[a], sets[b])) >= set_join.needed(50, 50)}
    assert linked <= {p for ps in found for p in ps} == {p for ps in plain for p in ps}
    assert 3 * sum(map(len, found)) < sum(map(len, plain))
    assert set_join.seen_before(np.zeros(0, np.uint64)).shape == (0, set_join.SEEN)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)]
    name = {v: v for e in edges for v in e}
    for _ in range(len(name)):
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    alone = {v for e in edges for v in e} - {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: c for v, c in name.items() if v not in alone}


def test_components_of_stars_take_one_round(spark, monkeypatch):
    names = []
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or df.localCheckpoint())
    stars = [(hub, hub + k) for hub in (0, 100, 200) for k in range(1, 40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {v: v // 100 * 100 for e in stars for v in e}
    assert names == ["components", "components-large", "components"]
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bit_table_sends_the_driver_one_small_table(spark):
    ids = spark.range(-500, 20_000, 1, 40)
    table = bloom.bit_table(ids)
    assert len(table) == 1 << (bloom.BITS - 3) and bloom.member(table, np.arange(-500, 20_000)).all()
    assert np.unpackbits(table).sum() <= 20_500 and not bloom.bit_table(ids.where("id > 30000")).any()
    for slots in (np.arange(0, 9000, 3), np.arange(0, 1 << bloom.BITS, 5), np.zeros(0, np.int64)):
        whole, data = bloom.packed(slots)
        assert (bloom.unpacked(whole, data) == slots).all() and len(data) == (1 << (bloom.BITS - 3) if whole else 4 * len(slots))


def test_bit_table_of_many_ids(spark):
    ids = spark.range(0, 2_000_000, 1, 4)
    table = bloom.bit_table(ids)
    expected = np.zeros(1 << bloom.BITS, bool)
    expected[bloom._slot(np.arange(2_000_000))] = True
    assert (np.unpackbits(table) == expected).all()


def test_set_join_coarse_sketches_tell_long_sets_apart():
    rng = np.random.default_rng(9)
    shared = rng.choice(1 << 47, 40_000, replace=False).astype(np.uint64)
    sets = [shared[lo : lo + n] for lo in (0, 150, 900, 20_000) for n in (3, 300, 2000, 2300, 9000, 19_000)]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a)]
    n = np.array([len(s) for s in sets])
    sketch = [set_join.counts(s, set_join.coarse_size(len(s))) for s in sets]
    a, b = np.array(pairs).T
    ok = set_join.sketches_meet(n[a], n[b], [sketch[i] for i in a], [sketch[i] for i in b])
    both = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in pairs])
    linked = both >= set_join.needed(n[a], n[b])
    assert linked.any() and not (linked & ~ok).any()  # no link is lost
    alike = np.maximum(n[a], n[b]) * set_join.NUM <= np.minimum(n[a], n[b]) * set_join.DEN
    assert not ok[(both == 0) & alike & (n[a] > 1000)].any()  # 64 counts let all of these pass
    assert not len(set_join.sketches_meet(n[:0], n[:0], [], []))


def test_set_join_entries_stay_small_in_many_buckets():
    rng = np.random.default_rng(4)
    e = np.zeros(30, set_join.ENTRY)
    e["h"], e["id"], e["n"], e["pos"] = rng.integers(0, 1 << 47, 30), np.sort(rng.integers(0, 200_000, 30)), rng.integers(20, 900, 30), rng.integers(0, 180, 30)
    e["seen"] = rng.integers(0, 1 << 48, (30, set_join.SEEN))
    e["lab"] = e["id"]
    assert (set_join.unpack_entries(memoryview(set_join.pack_entries(e))) == e).all()
    assert not len(set_join.unpack_entries(memoryview(set_join.pack_entries(e[:0]))))
    lz4 = pa.Codec("lz4")  # as in the shuffle
    assert lz4.compress(set_join.pack_entries(e)).size < 36 * len(e)  # of 56 bytes; 24 are hashes


def test_toxicity_lists_are_made_without_copies():
    rng = np.random.default_rng(2)
    idf = rng.random(5000) + 0.5
    at = [np.sort(rng.choice(5000, n, replace=False)).astype(np.int32) for n in [0, *rng.integers(1, 2500, 600)]]
    tf = [rng.integers(1, 9, len(x)).astype(np.int32) for x in at]
    vectors = pa.table({"at": pa.array([x.tobytes() for x in at], pa.binary()), "tf": pa.array([x.tobytes() for x in tf], pa.binary())})
    tracemalloc.start()
    first, of, value = toxicity.inverted(vectors, idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.3 * (of.nbytes + value.nbytes)
    whole = np.zeros((5000, len(at)), np.float32)
    for k, (x, y) in enumerate(zip(at, tf, strict=True)):
        w = (1 + np.log(y)) * idf[x]
        whole[x, k] = w / max(np.linalg.norm(w), 1e-12)
    term, example = np.nonzero(whole)
    assert (of == example).all() and (value == whole[term, example]).all() and (np.diff(first) == np.bincount(term, minlength=5000)).all()


def test_html_wrapper_decides_inside_articles(spark):
    page = "<body><article><h1>{0} title</h1><div class='zq7'>Read our {1} today</div><p>{0} first<p>{0} second<p class='kx'>Spread the word</p></article></body>"
    rows = [(k, f"http://a.example/{k}", page.format(w, "terms")) for k, w in enumerate(("red", "blue", "green", "grey"))]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"{w} title\n\n{w} first\n\n{w} second" for w in ("red", "blue", "green", "grey")}


def test_html_wrappers_of_all_layouts_and_long_pages(spark):
    rng, rows = random.Random(5), []
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    want = {}
    for k in range(200):  # 20 layouts with their own notices, long pages with a line after 3,000 tokens
        own = [text(20), text(9)] if k % 20 else [text(3) for _ in range(1600)]
        body = "".join(f"<p>{x}</p>" for x in own)
        rows.append((k, f"http://a.example/{k}", f"<body><div class=x{'abcdefghijklmnopqrst'[k % 20]}>Layout {k % 20} says</div>{body}<h6>The end line</h6></body>"))
        want[k] = "\n\n".join(own)
    for k in (900, 901):  # a host of two pages
        rows.append((k, "http://b.example/", f"<article><div class=zq>Two pages only</div><p>{text(15)}</p></article>"))
        want[k] = rows[-1][2].split("<p>")[1].split("</p>")[0]
    same = text(30)
    for k in range(910, 914):  # near copies and copies are no evidence
        rows.append((k, "http://c.example/", f"<article><p>{same}</p><p>{k if k < 913 else 910}</p></article>"))
        want[k] = f"{same}\n\n{k if k < 913 else 910}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == want
    hosts = pages.select(wrappers.host_of(F.col("url")).alias("host"), "html")
    few, all_at_once = ({r.host: set(r.template) for r in wrappers.host_wrappers(hosts, n).collect()} for n in (5, 1000))
    assert few == all_at_once and len(few["a.example"]) == 21


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<main><p>Long main text of the page<aside><article>teaser</article></aside></main>", "Long main text of the page"),
        ("<main><p>Long main text of the page</p><article class=comment>me too</article></main>", "Long main text of the page"),
        ("<main><p>Long main text of the page</p><article>more</article></main>", "Long main text of the page\n\nmore"),
        ("<div class='content has-sidebar'><article><p>kept</article><div class='sidebar-left'>out</div></div>", "kept"),
        ("<div class='no-sidebar'><article><div class=with-comments>kept</div></article></div>", "kept"),
        ("<article><p class=notice>out<p>one<ul><li class=share>out<li>two</ul><p>three<div class='social-share'>out</article><footer>f", "one\n\ntwo\n\nthree"),
        ("<article><table><tr><td class=ad>out<td>one<tr><td>two</table><dl><dt class=promo>out<dd>three</dl></article>", "one\n\ntwo\n\nthree"),
        ("<article><div>one<b>two</div></b><p>three</p></article>", "onetwo\n\nthree"),
    ],
)
def test_html_regions_and_skipping(body, want):
    assert wrappers.main_text(f"<html><body>{body}</body></html>") == want


def test_toxicity(spark, rows, docs, empty):
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["sun", "tree", "river", "stone", "bird"]) + str(rng.randint(0, 50)) for _ in range(20)) for _ in range(120)]
    train = spark.createDataFrame([(i, p + (" nastyword" if i % 3 == 0 else "")) for i, p in enumerate(plain)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    index = toxicity.fit(train, labels)
    some = spark.createDataFrame([(1, "what a NastyWord here"), (2, "sun1 tree2"), (3, None), (4, "")], "doc_id long, text string")
    got = by_id(toxicity.score(some, index))
    assert got[1].score > 0.9 and got[1].evidence[0].label == 1 and max(got[k].score for k in (2, 3, 4)) < 0.1
    weight = index.weight.astype(float)
    for i in range(0, weight.shape[1], 7):  # the pruned search is exact
        at = np.flatnonzero(weight[:, i])
        if len(at):
            want = np.sort(weight[at, i] @ weight[at])[::-1][: toxicity.NEIGHBOURS]
            cos = index.nearest(at, weight[at, i])[1]
            assert np.allclose(cos, want[want > 0][: len(cos)], atol=1e-5)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.document_toxicity(docs, none).collect()} == {0}
    assert toxicity.document_toxicity(empty, none).count() == 0
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


def test_toxicity_learns_rare_words(spark):
    rng = random.Random(6)
    plain = [" ".join(f"{rng.choice(['sun', 'tree', 'river'])}{rng.randint(0, 40)}" for _ in range(12)) for _ in range(400)]
    rare = [f"{c}zq{c}q" for c in "abcdefgh"]  # each word in four toxic examples: half of the sample is toxic, so its evidence is 2.8
    texts = [(i, p + (" " + rare[i // 2 % 8] if i < 64 and i % 2 else "")) for i, p in enumerate(plain[:64])]
    labels = spark.createDataFrame([(i, i % 2) for i in range(64)], "doc_id long, toxic int")
    index = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    new = [(i, plain[100 + i] + (" " + rare[i % 8] if i % 2 else "")) for i in range(40)]
    got = by_id(toxicity.score(spark.createDataFrame(new, "doc_id long, text string"), index))
    assert all(len(r.evidence) for r in got.values())  # every text has neighbours
    assert all((r.score >= toxicity.THRESHOLD) == k % 2 for k, r in got.items())


def test_token_counts(rows, docs, empty):
    from tokenizers import Tokenizer

    path = f"{TOKENIZER_FOLDER}/{TOKENIZER}"
    tok = Tokenizer.from_file(path)
    got = by_id(token_counts.document_tokens(docs, path))
    for i, text, *_ in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512)
    assert token_counts.document_tokens(empty, path).count() == 0
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    counter = token_counts.Counter(spec, token_counts.whole_tokens(spec))
    for c in range(0x530):  # the classes of every common code point
        s = f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}{chr(c)}'s<|endoftext|>"
        assert counter.count(s) == len(tok.encode(s, add_special_tokens=False).ids), hex(c)
    rng = random.Random(2)
    for _ in range(500):
        s = "".join(rng.choice(["a", "B", "'s", " ", "\n", "é", "²", "_", "1", "漢", "　", "\x1c", "😀", "́", "Ⅷ", "՘"]) for _ in range(30))
        assert counter.count(s) == len(tok.encode(s, add_special_tokens=False).ids), s


def test_mixing(rows, docs, empty):
    got = by_id(mixing.document_mix(docs))
    size = {i: len(words(t)) for i, t, *_ in rows}
    of = defaultdict(int)
    for i, _, _, s, *_ in rows:
        of[s] += size[i]
    order = sorted((s for s in of if s is not None), key=lambda s: s.encode()) + ([None] if None in of else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, active = dict.fromkeys(order, 0.0), 1.5 * sum(size.values()), set(order)
    while left > 1e-6:
        total = sum(weight[s] for s in active)
        for s in active:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in [s for s in active if target[s] >= 2 * of[s]]:
            left += target[s] - 2 * of[s]
            target[s] = 2 * of[s]
            active.discard(s)
    taken = defaultdict(int)
    for i, _, _, s, *_ in rows:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], of[s]) and abs(r.target - target[s]) < 1e-6 and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order if of[s] < 5000)
    assert by_id(mixing.document_mix(docs)) == got
    assert mixing.document_mix(empty).count() == 0


def test_knapsack_reaches_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        sizes = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in sizes])
        sums = {0}
        for s, c in zip(sizes, counts, strict=True):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        budget = rng.randint(0, 120)
        got = mixing.knapsack(sizes, counts, budget)
        assert (got <= counts).all() and int((got * sizes).sum()) == max(x for x in sums if x <= budget)


def test_repeats(rows, docs, empty):
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    for length in (repeats.LENGTH,):
        seen = Counter(b[k : k + length] for b in raw.values() for k in range(len(b) - length + 1))
        got = by_id(repeats.remove_repeats(docs, length=length))
        for i, b in raw.items():
            gone = repeats.covered([{"lo": k, "hi": k} for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1], length)
            edges = [0, *(x for s in gone for x in s), len(b)]
            kept = b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            r = got[i]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(kept), len(gone), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed > 0 for r in got.values()) > 5
    assert repeats.remove_repeats(empty).count() == 0


def test_fingerprints(spark, rows, docs, empty):
    got = by_id(fingerprints.edited_fingerprints(docs))
    order = sorted(rows, key=lambda r: -r[0])
    prints = defaultdict(set)
    for k, (i, text, *_) in enumerate(order):
        text, follower = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + follower[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        prints[text].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints)
    pair = spark.createDataFrame([(1, "a b c. d e f\n" * 3000), (2, "x y\nz"), (3, "z" + "a b c. d e f\n" * 3000 + "x y\n")], "k long, text string")
    fp = {r.k: r.fingerprint for r in fingerprints.fingerprint(pair, ["k"]).collect()}
    both = spark.createDataFrame([(fp[1], fp[2], fp[3])], "a struct<pair:array<long>,wide:array<long>,n:long>, b struct<pair:array<long>,wide:array<long>,n:long>, c struct<pair:array<long>,wide:array<long>,n:long>")
    assert both.select(fingerprints.to_string(fingerprints.combine(fingerprints.combine(F.col("a"), F.col("b")), F.col("b"), -1)) == fingerprints.to_string(F.col("a"))).first()[0]
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprints_of_scripts_and_short_items(spark):
    """Two thirds of a text stay: its likeness to the edited text tells so in any script, with and without marks."""
    rng = random.Random(5)
    of = lambda low, n: "".join(chr(low + rng.randrange(60)) for _ in range(n))
    english = lambda end: end.join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400))
    kinds = {
        "unpunctuated": lambda: english(" "),
        "an item a line": lambda: english("\n"),
        "han": lambda: of(0x4E00, 1500),
        "han with marks": lambda: "。".join(of(0x4E00, 15) for _ in range(80)),
        "devanagari": lambda: "। ".join(" ".join(of(0x0915, 5) for _ in range(8)) for _ in range(40)),
        "one long value": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(3000)),
    }
    rows = [(2 * k + c, name, make()) for k, (name, make) in enumerate(kinds.items()) for c in range(2)]
    names = {i: name for i, name, _ in rows}
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()
    for r in got:
        assert r.near_edited >= 0.35, (names[r.doc_id], r.near_edited)
        assert r.near_next <= 0.35 or r.near_next < r.near_edited, (names[r.doc_id], r.near_next)


def test_passages_keep_every_character(spark):
    rng = random.Random(6)
    texts = ["", "a", "a. b", "\x1f", "x" * 500, "😀" * 300, " " * 200, "word " * 90, "".join(rng.choice("ab .\n\x1fé😀") for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", fingerprints.passages(F.col("t")).alias("p")).collect():
        assert "".join(r.p).replace("\x1f", "") == r.t.replace("\x1f", "")
        assert all(p.count("\x1f") <= 1 or "\x1f" in r.t for p in r.p)


def test_decontamination(spark, rows, docs, empty):
    items = [(1, rows[3][1]), (2, "one two"), (3, None), (4, " .. "), (5, " ".join((rows[7][1] or "").split()[:14])), (5, rows[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = defaultdict(set)
    for i, t in items:
        w = token(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(i))
    for block in (decontaminate.BLOCK_WORDS, 1):
        got = by_id(decontaminate.contamination(docs, bench, block_words=block))
        for i, t, *_ in rows:
            w, hit, found = token(t), set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if x := windows.get(tuple(w[k : k + size])):
                        hit |= set(range(k, k + size))
                        found |= x
            want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
    kept = by_id(decontaminate.decontaminate(docs, bench))
    clean = {i for i, r in got.items() if not r.contaminated}
    assert clean <= kept.keys() and all(kept[r[0]].text == r[1] for r in rows if r[0] in clean)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("block", [200_000, 30])
def test_decontamination_keeps_items_without_an_id(spark, rows, block):
    """Null and repeated ids, null and empty items: equal to the query's SQL, in one block and in many."""
    import duckdb

    from cohortlens.llm.queries import _OP10

    texts = [t for _, t, *_ in rows if t and 12 <= len(words(t)) < 200]
    items = [(None, texts[0]), (None, texts[1]), ("b", texts[2]), ("b", texts[3]), ("a", None), ("c", ""), (None, "One two"), ("d", " ".join(words(texts[4])[3:15]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [r for r in rows if len(words(r[1])) < 1000]  # the SQL copies a text's words for every window
    mine = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, decontaminate.contamination(mine, bench, block_words=block).collect()))
    con = duckdb.connect()
    con.register("documents", mine.toArrow())
    con.register("benchmark", bench.toArrow())
    names = ", ".join(["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    assert got == sorted(con.sql(f"SELECT {names} FROM ({_OP10})").fetchall())
    assert sum(r[2] > 0 for r in got) >= 6
    kept = {r.doc_id: r.text for r in decontaminate.decontaminate(mine, bench, max_coverage=1.0, block_words=block).collect()}
    of = dict((r[0], r[1]) for r in rows)
    assert len(kept) == len(of) and all(kept[r[0]] == of[r[0]] for r in got if not r[2])
    assert all(len(words(kept[r[0]])) <= len(words(of[r[0]])) for r in got)


def test_token_counts_merge_by_the_model():
    """Rare pieces go through the merges alone, whatever their bytes: no whole encoding of each."""
    from tokenizers import Tokenizer

    with open(f"{TOKENIZER_FOLDER}/{TOKENIZER}", encoding="utf-8") as f:
        spec = f.read()
    counter, tok = token_counts.Counter(spec, frozenset()), Tokenizer.from_str(spec)

    class Merges:
        model, pre_tokenizer = tok.model, tok.pre_tokenizer

    counter.tokenizer = Merges
    texts = ["".join(map(chr, range(0x20, 0x180))), "\x00\x1f\x7f\x80\xad\xa0", "queauxè 漢字😀՘ n'est-ce  pas\n\n", "<|endoftext|>x<|endoftext|>"]
    for s in texts:
        assert counter.count(s) == len(tok.encode(s, add_special_tokens=False).ids), s


def test_toxicity_index_is_lean_on_the_driver(spark):
    """The driver makes and sends the lists alone; the search's tables and the leave-one-out votes are the tasks'."""
    import pickle

    texts = [(k, f"{'vile' if k % 2 else 'kind'} words {k % 7} and {k % 5} more" if k % 11 else None if k % 2 else "") for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, toxic int")
    index = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert not {"dense", "wide_of", "bucket", "padded"} & set(vars(index))
    assert index.steps is not None
    whole = toxicity.left_out_votes(spark, index)
    own = np.arange(len(index.label))
    assert "dense" not in pickle.loads(pickle.dumps(index)).__dict__
    assert np.array_equal(index.votes_without(own), whole, equal_nan=True)
    weight = index.weight.astype(float)
    for i in range(0, len(own), 9):  # by the whole matrix
        cos = weight[:, i] @ weight
        cos[i] = 0
        near = np.lexsort((own, -cos))[: toxicity.NEIGHBOURS]
        near = near[cos[near] > 0]
        if not len(near):  # a text without terms
            assert np.isnan(whole[i])
            continue
        part = (weight[:, i] * index.sure) @ weight[:, near]
        assert abs(index.vote(near, cos[near], part) - whole[i]) < 1e-4
