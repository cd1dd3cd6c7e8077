"""Contexts of one gram: only those that can share a window are fetched, those of hot grams in stretches."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from wordloom.llm import substrings as su
from wordloom.llm.exchange import unpack


def _routed(texts, parts=3):
    """The steps of ``_with_spans`` in this process: rows of the anchors' reduce, of the contexts' map and of their reduce."""
    batch = pa.RecordBatch.from_pydict({"doc": pa.array([i for i, _ in texts], pa.int64()), "text": [t for _, t in texts]})
    rows = lambda batches: [r for b in batches for r in b.to_pylist()]
    table = lambda got: [pa.RecordBatch.from_pylist(got, su._ROUTED)] if got else []
    first = rows(su._anchor_reduce(iter(table(rows(su._anchor_map(parts)(iter([batch])))))))
    asked = {}
    for r in first:
        if r["kind"] == "asked":
            asked.setdefault((r["doc"], r["mark"]), []).append(r["data"])
    press = zstandard.ZstdCompressor()
    own = [{"doc": i, "mark": m, "z": press.compress(t.encode()), "asked": asked[i, m]}
           for i, t in texts if i is not None and (i, m := su._mark(t.encode())) in asked]
    # two tasks
    sent = [r for half in (own[::2], own[1::2]) if half for r in rows(su._context_map(parts)(iter([pa.RecordBatch.from_pylist(half)])))]
    last = rows(su._context_reduce(iter(table(sent))))
    return first, sent, last


def _cut(texts, first, last):
    places = {}
    for r in first + last:
        if r["kind"] in ("covered", "windows"):
            places.setdefault((r["doc"], r["mark"]), []).append((r["kind"], r["data"]))
    out = []
    for i, t in texts:
        t = t.encode()
        got = places.get((i, su._mark(t)), [])
        out.append(su._spans([k for k, _ in got], [d for _, d in got], len(t)))
    return out


def _brute(texts):
    seen = {}
    for i, t in texts:
        t = t.encode()
        for a in range(len(t) - su.WIN + 1):
            w = t[a:a + su.WIN]
            seen[w] = min(i, seen.get(w, i))
    out = []
    for i, t in texts:
        t, gone = t.encode(), np.zeros(len(t.encode()), bool)
        for a in range(len(t) - su.WIN + 1):
            if seen[t[a:a + su.WIN]] < i:
                gone[a:a + su.WIN] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def _texts(n, seed):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 7))) for _ in range(400)]
    common = " ".join(draw.choices(words, k=25))
    texts = []
    for i in range(n):
        kind, around = i % 5, [" ".join(draw.choices(words, k=draw.randint(0, 12))) for _ in range(2)]
        if kind == 0:
            text = " ".join(around)
        elif kind == 1:
            text = common[draw.randint(0, 60):draw.randint(90, len(common))]
        elif kind == 2:
            text = around[0] + common + around[1]
        elif kind == 3:
            at = draw.randrange(len(common))
            text = around[0] + common[:at] + draw.choice("xyz") + common[at:] + around[1]
        else:
            text = texts[draw.randrange(len(texts))][1] + around[0]
        texts.append((draw.randrange(n), text))
    return texts


@pytest.mark.parametrize("hot", [1, 3, 4096])
@pytest.mark.parametrize("rows", [50, 1 << 18])
def test_spans_are_those_of_all_windows(monkeypatch, hot, rows):
    monkeypatch.setattr(su, "HOT", hot)
    monkeypatch.setattr(su, "ROWS", rows)
    for seed in range(4):
        texts = _texts(70, seed)
        first, _, last = _routed(texts)
        assert _cut(texts, first, last) == _brute(texts)


def _asked(first):
    return sum(len(unpack(r["data"])[0]) for r in first if r["kind"] == "asked")


def test_grams_that_agree_by_chance_are_not_fetched():
    """Texts share words in pairs, never half a window beside a gram: nothing to fetch."""
    draw = random.Random(5)
    pairs = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(30)]
    noise = lambda: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=40))
    texts = [(i, "".join(noise() + draw.choice(pairs) for _ in range(20))) for i in range(60)]
    first, sent, _ = _routed(texts)
    assert _asked(first) == 0 and not sent


def test_hot_grams_send_stretches(monkeypatch):
    """A passage in different surroundings: its edge sends a few stretches for a context, not each of its windows."""
    draw = random.Random(6)
    passage = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=120))
    noise = lambda: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=60))
    texts = [(i, noise() + passage + noise()) for i in range(200)]
    monkeypatch.setattr(su, "HOT", 3)
    first, sent, last = _routed(texts)
    n = sum(len(unpack(r["data"][8:8 + int.from_bytes(r["data"][:8], "little")])[0]) for r in sent if r["kind"] == "contexts")
    assert _asked(first) > 150 and n <= 2 * _asked(first)
    assert _cut(texts, first, last) == _brute(texts)
