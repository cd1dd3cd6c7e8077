"""Spelling variants, packing and token alignment against brute force, on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wordloom.llm import align, packing, pieces, variants
from wordloom.session import materialize

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "　", " ", "\x85", "'s", "'", "l", "ll", ".", ",", "!", "1", "é", "ß", "日本",
        "<|endoftext|>", "<|endof", "text|>", "<s>", "</s>", "▁", "\x00", "\x1c", "word", "\r\n", " '", "😀", "the ", "ing", "<0x41>"]
SCHEMA = "doc_id long, text string, place string, `n` string, ids string, word string"


def random_texts(n, seed=0, longest=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def table(spark, rows):
    """Documents with columns named like the operators' own ones."""
    return spark.createDataFrame([(d, t, "x", None, "y", "z") for d, t in rows], SCHEMA)


AWKWARD = [(7, None), (7, None), (8, ""), (9, "same words here " * 3), (9, "same words here " * 3), (None, "no id"), (3, "ünïcödé"),
           (4, "  lead and trail  "), (5, "a" * 5000), (6, "x y " * 4000)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    plain, own = Tokenizer.from_file(A), Tokenizer.from_file(A)
    plain.encode_special_tokens = True
    return own, plain


def test_pieces_give_the_library_ids(library):
    texts = random_texts(5000, 1, 14) + ["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>", "x<|endoftext|><|endoftext|>"]
    got = []
    for first, ids, at in pieces.text_ids(A, [t.encode() for t in texts] + [None]):
        assert first == len(got)
        got += [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])]
    assert got == [library[0].encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_memo_forgets_without_changing_values():
    small = pieces.Pieces(lambda p: [len(x) for x in p], limit=4)
    for _ in range(3):
        for t in (b"one two three", b"four five six seven", b"one six"):
            cut, values, codes, bounds = small.group([t, b"", t])
            assert [cut[c] for c in codes[:bounds[1]]] == re.findall(rb"^\w+| \w+", t) and bounds[1] == bounds[2]
            assert values == [len(c) for c in cut] and len(small.young) + len(small.old) <= 12


# ---- spelling variants ----

def brute_variants(rows, least=3):
    count = Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            count[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= least}
    return brute_groups(words)


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) - len(x) == 1 and any(x == y[:k] + y[k + 1:] for k in range(len(y)))


def brute_groups(words):
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_word_counts_and_groups_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["garden", "Gärten", "window", "straße", "façade", "houses", "Éclair"]
    rows = [(i, " ".join(rng.choice(base) if rng.random() < .7 else rng.choice(base).replace(rng.choice("aeno"), rng.choice("xyz ") * rng.randint(0, 2))
                         for _ in range(60))) for i in range(300)] + AWKWARD
    words = variants.word_counts(table(spark, rows))
    want = brute_variants(rows)
    assert len(want) > 10 and rows_of(variants.group_variants(words)) == want


@pytest.mark.parametrize("tile", [4096, 8])
def test_groups_of_many_near_words_whole_and_in_tiles(spark, tile):
    rng = random.Random(tile)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))): rng.randint(1, 400) for _ in range(250)}
    words |= {"abcde" * 12: 9, "abcde" * 12 + "x": 3, "abcdf" + "abcde" * 11: 4, "ÿéàbc": 5, "ÿéàbd": 10}
    got = variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"), tile)
    assert rows_of(got) == brute_groups(words)


def test_chains_of_forms_reach_their_end(spark):
    words = {"aaaaa" + "b" * k: 2 ** (20 - k) for k in range(20)}
    got = rows_of(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_groups(words) and {v[1] for v in got.values()} == {"aaaaa"}


def test_variants_of_empty_tables(spark):
    assert rows_of(variants.group_variants(variants.word_counts(table(spark, [])))) == {}
    assert rows_of(variants.group_variants(variants.word_counts(table(spark, [(1, None), (2, "")])))) == {}


# ---- packing ----

def check_packing(out, texts, library, window):
    """Every id in one piece, sequences without gaps, no padding but none at all."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at and n > 0
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)
    assert sorted(sequences) == list(range(len(sequences)))
    want = defaultdict(list)
    for d, t in texts:
        want[d].append(library.encode(t or "", add_special_tokens=False).ids + [1])
    assert set(docs) == set(want)
    for d, lists in want.items():
        assert sum(r.length for r in docs[d]) == sum(map(len, lists))
        if len(lists) == 1:
            mine = sorted(docs[d], key=lambda r: r.start)
            assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == lists[0]
            assert {r.doc_tokens for r in mine} == {len(lists[0])}


@pytest.mark.parametrize("window", [16, 256])
def test_packed_pieces_hold_every_id_once_without_padding(spark, library, window):
    texts = list(enumerate(random_texts(600, window, 60)))
    out = packing.pack(materialize(packing.tokenize(table(spark, texts + [(-1, None), (-2, "")]).repartition(5), A)), window).collect()
    check_packing(out, texts + [(-1, None), (-2, "")], library[0], window)


def test_packing_of_awkward_rows_and_empty_tables(spark, library):
    out = packing.pack(materialize(packing.tokenize(table(spark, AWKWARD), A)), 64).collect()
    check_packing(out, AWKWARD, library[0], 64)
    assert packing.pack(materialize(packing.tokenize(table(spark, []), A)), 64).collect() == []
    with pytest.raises(ValueError):
        packing.pack(packing.tokenize(table(spark, []), A), 100)


def test_one_length_for_all_documents_is_cut_evenly(spark, library):
    texts = [(i, "a" * 10) for i in range(1000)]
    out = packing.pack(materialize(packing.tokenize(table(spark, texts), A)), 64).collect()
    check_packing(out, texts, library[0], 64)


def test_combinations_fill_the_window_and_counts_solve_the_histogram():
    rng = np.random.default_rng(1)
    h = np.bincount(rng.integers(1, 64, 3000), minlength=64)
    rows = packing.combinations(h, 64)
    assert (rows.sum(axis=1) == 64).all() and len(np.unique(rows, axis=0)) == len(rows)
    x = packing.repeat_counts(rows, h)
    used = np.bincount(rows.ravel(), np.repeat(x, 4), 64)
    assert (x >= 0).all() and np.abs(used[1:] - h[1:]).sum() < 0.1 * h.sum()
    # the conditions of a least-squares solution: no combination pulls, but where its count is zero it may push
    pull = ((np.r_[0, (h - used)[1:]])[rows] * (rows > 0)).sum(axis=1)
    assert pull.max() < 1.0 and np.abs(pull[x > 1]).max() < 1.0
    p = packing.plan(h, 64)
    assert p["edges"][-1] < 0.2 * (h * np.arange(64)).sum()


# ---- alignment ----

def brute_alignment(rows, a):
    import sentencepiece
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of, name = align._byte_of(), {i: t for t, i in a.get_vocab().items()}

    def bytes_of(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    found, counts = [], Counter()
    for _, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        xs = [bytes(byte_of[c] for c in name[i]) for i in x]
        ys = [bytes_of(i) for i in y]
        if not t or not b"".join(xs) == b"".join(ys) == (" " + t).encode():
            found.append(None)
            continue
        xe, ye = np.cumsum([len(s) for s in xs]).tolist(), np.cumsum([len(s) for s in ys]).tolist()
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y))
                 if max(xe[i] - len(xs[i]), ye[j] - len(ys[j])) < min(xe[i], ye[j])]
        counts.update(links)
        text, groups, shared, p, q = [], 0, 0, 0, 0
        for e in sorted(set(xe) & set(ye)):
            i, j = xe.index(e) + 1, ye.index(e) + 1
            text.append(",".join(map(str, x[p:i])) + "|" + ",".join(map(str, y[q:j])))
            groups, shared, p, q = groups + 1, shared + (i - p) * (j - q), i, j
        found.append((len(x), len(y), groups, len(links), shared, links, hashlib.sha256(";".join(text).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, q), n in counts.items():
        most[q] = max(most[q], n)
    return sorted(((d, 0, 0, 0, 0, 0, 0, 0, "") if v is None else
                   (d, *v[:5], sum(counts[k] == most[k[1]] for k in v[5]), sum(counts[k] for k in v[5]), v[6])
                   for (d, _), v in zip(rows, found, strict=True)), key=repr)


def aligned_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum",
                                               "groups_sha256").collect()), key=repr)


@pytest.mark.parametrize("max_pairs", [align.BROADCAST_PAIRS, 200])
def test_alignment_equals_brute_force_with_one_table_of_pairs_and_in_parts(spark, library, max_pairs):
    rows = list(enumerate(random_texts(800, 2))) + AWKWARD[:-2] + [(50_000, "x y " * 60)]
    got = align.report(table(spark, rows).repartition(3), A, B, max_pairs=max_pairs)
    assert aligned_rows(got) == brute_alignment(rows, library[1])


def test_alignment_of_empty_tables_and_long_texts(spark):
    assert aligned_rows(align.report(table(spark, []), A, B)) == []
    assert aligned_rows(align.report(table(spark, [(1, None), (2, "")]), A, B)) == [(d, 0, 0, 0, 0, 0, 0, 0, "") for d in (1, 2)]
    r = align.report(table(spark, [(1, "long text " * 200_000)]), A, B).collect()[0]
    assert r.n_a >= 400_000 and r.n_links >= r.n_groups >= 400_000


def test_sparse_products_equal_dense_ones():
    rng = np.random.default_rng(4)
    ends, other = np.cumsum(rng.integers(1, 5, 30)), None
    cuts = np.sort(rng.choice(np.arange(1, ends[-1]), 12, replace=False))
    other = np.append(cuts, ends[-1])
    x, y = align.Csr.of_spans(ends), align.Csr.of_spans(other)
    dense = [np.zeros((len(m.starts) - 1, m.width), int) for m in (x, y)]
    for d, m in zip(dense, (x, y)):
        d[m.rows, m.columns] = 1
    row, column, value = x.times(y.transposed())
    product = np.zeros((len(ends), len(other)), int)
    product[row, column] = value
    assert (product == dense[0] @ dense[1].T).all()
