"""Operators against brute force on small tables with nulls, empties, repeats, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from wordloom.llm import bpe, decontam, jaccard, language, licenses, lines, pages, quality, rans, substrings

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def make_texts(seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 160))) for _ in range(25)]
    texts = list(base)
    for t in base[:12]:
        words = t.split()
        for _ in range(max(1, len(words) // 40)):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        texts += [t, " ".join(words), rnd.choice(base) + ".\n" + t]
    return [*texts, None, "", " \n ", "x", " ".join(base), " ".join(rnd.choice(vocab) for _ in range(20000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "part", "row") for i, t in enumerate(make_texts())]
    rows += [(3, rows[3][1], "part", "row"), (None, rows[0][1], None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kind string, data string").repartition(3).cache()


def texts_of(docs):
    return {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id is not None}


def test_substrings(docs):
    texts, seen = texts_of(docs), set()
    want = {}
    for d in sorted(texts):
        b = texts[d]
        cov = bytearray(len(b))
        wins = [b[i:i + 50] for i in range(len(b) - 49)]
        for i, w in enumerate(wins):
            if w in seen:
                cov[i:i + 50] = b"\1" * 50
        seen.update(wins)
        want[d] = (len(b), sum(cov), hashlib.sha256(bytes(x for x, c in zip(b, cov) if not c)).hexdigest())
    got = substrings.report(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert substrings.dedup(docs).columns == docs.columns


def test_substrings_hot_windows(docs, monkeypatch):
    """The per-window route for grams with many contexts gives the same result."""
    want = sorted(map(tuple, substrings.report(docs).drop("spans").na.fill(-1).collect()))
    monkeypatch.setattr(substrings, "HOT", 1)
    assert sorted(map(tuple, substrings.report(docs).drop("spans").na.fill(-1).collect())) == want


def test_suffix_blocks_cover_segment_edges():
    rnd = np.random.default_rng(5)
    text = rnd.integers(97, 101, 5000).astype(np.uint8)
    at, _ = substrings.anchors(text)
    for i in range(len(text) - 49):
        assert ((at >= i) & (at <= i + substrings.REACH)).any()


def test_jaccard(docs):
    texts = texts_of(docs)
    sets = {}
    for d, b in texts.items():
        w = b.lower().split()
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in texts}
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {find(d) for d in texts}


def test_parity_words_lose_no_pair():
    rnd, bands = np.random.default_rng(1), jaccard.Bands()
    for n in (1, 2, 5, 9, 40, 300):
        for _ in range(30):
            a = np.unique(rnd.integers(0, 1 << 62, n).astype(np.uint64))
            b = a.copy()
            for _ in range(len(a) // 9):
                b[rnd.integers(len(b))] = rnd.integers(1 << 62)
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                ka, kb = (np.concatenate([x.keys(s) for x in bands.of(len(s))]) for s in (a, b))
                assert len(np.intersect1d(ka, kb))


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7, 8, 9), 1), 20: 20, 21: 20}


def test_lines(docs):
    texts, seen = texts_of(docs), {}
    for d in sorted(texts):
        for s, e, u in lines.units(texts[d]):
            seen.setdefault(u, []).append((d, s, e))
    cov = {d: bytearray(len(b)) for d, b in texts.items()}
    for places in seen.values():
        for d, s, e in sorted(set(places))[1:]:
            cov[d][s:e] = b"\1" * (e - s)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in lines.report(docs).collect() if r.doc_id is not None}
    assert got == {d: (sum(c), hashlib.sha256(bytes(x for x, k in zip(texts[d], c) if not k)).hexdigest()) for d, c in cov.items()}


def test_lines_repeated_row(spark):
    """A row given twice keeps its first occurrences, with both copies in one task or in two."""
    text = "one two three four five six\nseven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (2, text), (2, text)]
    for parts in (1, 4):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "doc_id long, text string")
        assert sorted((r.doc_id, r.text) for r in lines.dedup(docs).collect()) == [(1, text), (1, text), (2, "\n"), (2, "\n")]
        assert {(r.doc_id, r.n_units) for r in lines.report(docs).collect()} == {(1, 0), (2, 2)}


def test_lines_of_any_length(spark):
    """Short lines and sentences, and those of scripts without blanks, are units too."""
    rows = [(1, "Share this\nYes. It is so.\n今天天气很好。我们去公园！"), (2, "share  THIS\nNo. It is so.\n他说。我们去公园！\nวันนี้อากาศดี"), (3, "วันนี้อากาศดี\nMr. Who")]
    docs = spark.createDataFrame([*rows, (4, "Mr. Else\n1. First\n1. Second")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup(docs).collect()}
    assert got == {1: rows[0][1], 2: "\nNo. \n他说。\nวันนี้อากาศดี", 3: "\nMr. Who", 4: "Mr. Else\n1. First\n1. Second"}
    assert {r.doc_id: r.text for r in lines.dedup(docs, least_line=99, least_sentence=99).collect()}[3] == rows[2][1]


def test_bpe_matches_library(docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(MULTI)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    own = bpe.encoder(MULTI, public_tokenizers.PATTERN)
    hard = ["", "a  b\n\n c", "it's 'she  ", "  ", "x" * 300, "日本語 text，", "a b\x1cc", "1234567 %%% ---\r\n\r\n", "),. ok."]
    for t in hard:
        assert own.encode(t).tolist() == enc.encode_ordinary(t)
    rows = {r.doc_id: r for r in bpe.digests(docs, MULTI, public_tokenizers.PATTERN).collect()}
    for d, b in texts_of(docs).items():
        assert rows[d].ids_sha256 == hashlib.sha256(",".join(map(str, enc.encode_ordinary(b.decode()))).encode()).hexdigest()
        assert rows[d].decoded_sha256 == hashlib.sha256(b).hexdigest()
    back = bpe.decode(bpe.encode(docs, MULTI, public_tokenizers.PATTERN), MULTI, public_tokenizers.PATTERN)
    assert Counter(bytes(r.text) for r in back.collect()) == Counter((r.text or "").encode() for r in docs.collect())


def test_bpe_edits():
    ranks, rnd = bpe.load_ranks(MULTI), random.Random(2)
    table = bpe.PrefixTable(ranks, b"therefore")
    for _ in range(60):
        s = rnd.randrange(len(table.text) + 1)
        e = min(len(table.text), s + rnd.randrange(4))
        table.replace(s, e, rnd.choice([b"", b"in", b"thering", b"x"]))
        assert table.last == bpe.PrefixTable(ranks, table.text).last
    assert [ranks.rank[t] for t in ranks.merged(table.text)] == table.ids()


def test_token_files(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    rans.write_ids(rans.tokenize(docs, path), str(tmp_path / "ids"))
    want = sorted(((r.doc_id is not None, r.doc_id or 0, tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs.collect()))
    start, rows = 0, []
    for has, d, ids in want:
        rows.append((d if has else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, rans.read_digests(spark, str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    assert got == rows


def test_rans_checkpoints_and_crc():
    rnd = np.random.default_rng(0)
    ids = rnd.zipf(1.3, 70_000).clip(max=900).astype(np.uint32)
    coder = rans.Coder(rans.quantise(np.bincount(ids, minlength=950), 16), 16)
    lanes, marks, words = coder.encode(ids)
    for mark in (0, 1):
        tail = coder.decode(len(ids), lanes, marks, words, mark)
        assert (tail == ids[len(ids) - len(tail):]).all()
    assert rans.crc32_combine(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_decontamination(spark, docs):
    texts = texts_of(docs)
    words = decontam.alnum_words(texts[0]) + decontam.alnum_words(texts[1])
    items = [(1, b" ".join(words[5:18]).decode()), (2, "zz yy"), (3, None), (4, ""), (5, b" ".join(words[:3]).decode()), (6, "qq " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    win = {}
    for i, t in items:
        w = decontam.alnum_words((t or "").encode())
        for j in range(len(w) - min(10, len(w)) + 1 if w else 0):
            win.setdefault(tuple(w[j:j + min(10, len(w))]), set()).add(str(i))
    for options in ({}, {"block_words": 20}):
        for r in decontam.report(docs, bench, **options).collect():
            w = decontam.alnum_words(texts.get(r.doc_id, texts[0]))
            hit, found = set(), set()
            for k in {len(x) for x in win}:
                for j in range(len(w) - k + 1):
                    if tuple(w[j:j + k]) in win:
                        hit.update(range(j, j + k))
                        found |= win[tuple(w[j:j + k])]
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    left = decontam.report(decontam.clean(docs, bench), bench).filter("contaminated").count()
    assert left == 0 and decontam.clean(docs, bench).columns == docs.columns


def test_licenses():
    got = licenses.scan_text(b"x. Released under the terms of the MIT License. MIT license mit license")
    assert (got[1], got[2], got[4], got[5]) == (3, 7, "mit", "MIT-notice,mit")
    assert licenses.scan_text(None)[:4] == (0, 0, None, None)
    full = licenses.TEMPLATES["MIT"]
    given = full.replace("<<beginOptional>>", "").replace("<<endOptional>>", "").replace("<<var;max=12>>", "the authors")
    assert licenses.scan_text(given.encode())[5] == "MIT" and licenses.scan_text(given.replace("sublicense", "sell").encode())[5] == ""


def test_quality(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa " + " ".join(f"w{i} v{i}" for i in range(40))
    rows = [(i, (good if i % 4 else good.replace(" ", "### ")) + f" end{i}", "en", 1) for i in range(2400)] + [(9000, None, None, 1), (9001, "", "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rule int")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 2400)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert all(got[i].kept == (i % 4 > 0) for i in range(2400)) and not got[9000].kept and got[9001].base_failed
    assert quality.features_of(b"a b c a b c\n\nx #|\nx #|")[:5] == (10, 12, 4, 1, 6)
    for x, n, p in ((0, 10, 0.3), (4, 9, 0.5), (9, 9, 0.2)):
        exact = sum(__import__("math").comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))
        assert quality.binomial_at_most(x, n, p) == pytest.approx(exact)


def test_language(spark):
    say = {"en": "the house and the garden with this thing", "de": "das haus und der garten mit dem schönen ding",
           "fr": "la maison et le jardin avec cette chose", "es": "la casa y el jardín con esta cosa señor"}
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(t.split(), k=20)), lang, lang) for i in range(80) for lang, t in say.items()]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)] + [(1000, None, "en", ""), (1001, "123 -- 4", None, ""), (None, "la casa", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.train(docs.filter(~language.held_out()))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[1001].score == 0
    assert sum(got[r[0]].lang_pred == r[2] for r in rows[:320]) >= 316
    assert language.train(docs.limit(0)) is None


def test_pages(spark):
    def page(i):
        return (f"<html><head><title>t{i}</title><script>var a='<p>no</p>'</script></head><body><nav><a href=/>Menu {i}</a></nav>"
                f"<p>Always the same line</p><p>Body {i} &amp; more<br>text <b>bold {i}</b></p><div class='ad box'>Buy {i}</div>"
                f"<form>mail</form><div id=comments><p>First {i}</p></div><footer>f</footer></body></html>")
    rows = [(i, "https://h.example/x", page(i), "t") for i in range(8)] + [(20, None, "<p>a<p>b", ""), (21, "https://z.example", None, ""), (None, "https://q.example", "", "")]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[5].text == "Body 5 & more text bold 5" and got[5].n_chars == len(got[5].text)
    assert got[20].text == "a b" and got[21].text == "" and got[None].text == ""
    assert pages.main_text("<div>" * 5000 + "deep" + "</div>" * 5000, None) == "deep"


def test_pages_long_lists(monkeypatch):
    """More than 2000 siblings, and the same alignment in blocks as at once."""
    def tree(page):
        root = pages.parse(page)
        pages.number(root)
        return root
    same = [f"<p>line {i}</p>" for i in range(2100)]
    a, b = tree("<p>line 2000</p><p>new</p>" + "".join(same)), pages.compact(tree("".join(same)))
    assert sum(n.hash == h for n, _, h in pages.aligned(a, b)) == 2100
    rnd = random.Random(4)
    for _ in range(30):
        def page(n):
            return "".join(rnd.choice(["<p>{}</p>", "<div>{}<p>x</p></div>", "<ul><li>{}<li>y</ul>", "<div><p>{}</p><p>{}</p></div>", "{}<hr>"])
                           .format(rnd.randrange(9), rnd.randrange(50)) for _ in range(n))
        x, y = tree(page(rnd.randrange(30, 60))), pages.compact(tree(page(rnd.randrange(30, 60))))
        got = []
        for block in (1 << 40, 4_000_000, 1000, 100, 1):
            monkeypatch.setattr(pages, "BLOCK", block)
            got.append([(n.number, p) for n, p, _ in pages.aligned(x, y)])
        assert got[1:] == got[:1] * 4


def test_pages_several_layouts(spark):
    """What the page with the smallest id lacks is template all the same, in each layout; repeated pages prove nothing."""
    def news(i):
        return f"<div class=top><p>Subscribe</p></div><div class=news><h2>Head {i}</h2><p>News {i}</p><p>Follow us</p></div>"

    def shop(i):
        return f"<div class=top><p>Subscribe</p></div><div class=shop id=item-{i}><p>Ware {i}</p><p>Free returns</p></div>"
    html = ["<h1>Welcome</h1><p>Home page</p>", *map(news, range(1, 9)), *map(shop, range(9, 17)), *["<pre>Copied</pre>"] * 6]
    rows = [(i, f"https://h.example/{i}", p) for i, p in enumerate(html)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "Welcome Home page", **{i: f"Head {i} News {i}" for i in range(1, 9)}, **{i: f"Ware {i}" for i in range(9, 17)},
                   **dict.fromkeys(range(17, 23), "Copied")}


@pytest.mark.parametrize("page, text", [
    ("<p>a</p><svg class='i' /><p>b</p>", "a b"), ("<p>a</p><svg><text>x</text></svg><p>b</p>", "a b"),
    ("<title-bar>a</title-bar><p>b</p>", "a b"), ("<p>a</p><select-box x=1><p>b</p>", "a b"),
    ("<body class='has-sidebar'><p>a</p></body>", "a"), ("<body class='sidebar'><p>a</p></body>", "a"),
    ("<div class='content no-sidebar'><p>a</p></div>", "a"), ("<div class='article-header'><h1>a</h1></div><p>b</p>", "a b"),
    ("<div class='sidebar left'><p>a</p></div><p>b</p>", "b"), ("<div class='page sidebar'><article class='related'>a</article>z</div>", "a"),
    ("<div class='sidebar'><article>teaser</article></div><article>a</article>", "a"), ("<footer><article>a</article></footer><p>b</p>", "b"),
    ("<div data-id='menu'>a</div>", "a")])
def test_pages_markup(page, text):
    assert pages.main_text(page, None) == text


@pytest.mark.parametrize("run", [substrings.report, substrings.dedup, jaccard.near_duplicates, lines.report, licenses.scan])
def test_empty_table(docs, run):
    assert run(docs.limit(0)).count() == 0


def test_empty_token_files(spark, docs, tmp_path):
    rans.write_ids(rans.tokenize(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path / "none"))
    assert rans.read_digests(spark, str(tmp_path / "none")).count() == 0


def test_decontamination_cuts_in_several_blocks(spark):
    docs = spark.createDataFrame([(1, "x One two THREE, y"), (2, None), (3, "four five"), (4, "plain\ttext"), (4, "plain\ttext")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five"), (3, None)], "item_id long, text string")
    for words in (1, 1_000_000):
        got = sorted((r.doc_id, r.text) for r in decontam.clean(docs, bench, block_words=words).collect() if r.doc_id != 2)
        assert got == [(1, "x , y"), (3, ""), (4, "plain\ttext"), (4, "plain\ttext")]
    plan = decontam.clean(docs, bench).filter("length(text) > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 0
