"""License templates against regular expressions; benchmark items without ids, and many blocks."""

import random
import re
import time

from pyspark.sql import functions as F

from wordloom.llm import decontam, licenses
from wordloom.llm.common import alnum_words

BSD3 = licenses.TEMPLATES["BSD-3-Clause"]
MARKUP = re.compile(r"<<(?:var;max=\d+|beginOptional|endOptional)>>")


def plain(template):
    """The template's own wording, its replaceable words filled in."""
    out = re.sub(r"<<one;([^|>]*)[^>]*>>", r"\1", re.sub(r"<<var;max=\d+>>", "the owner", template))
    return MARKUP.sub(" ", out)


def as_regex(template):
    """The template over words that each have a blank behind them."""
    out = []
    for i, part in enumerate(re.split(r"<<(.*?)>>", template, flags=re.S)):
        if i % 2 == 0:
            out += [re.escape(w.decode()) + " " for w in alnum_words(part.encode())]
        elif part == "beginOptional":
            out.append("(?:")
        elif part == "endOptional":
            out.append(")?")
        elif part.startswith("one;"):
            out.append("(?:" + "|".join(re.escape(w) for w in part[4:].lower().split("|")) + ") ")
        else:
            out.append(f"(?:[^ ]+ ){{0,{part[8:]}}}")
    return re.compile("".join(out))


def test_automata_equal_regular_expressions():
    rng = random.Random(3)
    templates = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 260}
    templates["own"] = "a <<var;max=2>> b <<beginOptional>>c <<beginOptional>>d<<endOptional>> c<<endOptional>> <<one;a|e>>"
    for label, template in templates.items():
        machine, rule = licenses.Automaton(label, template), as_regex(template)
        known = sorted({w.decode() for s in machine.words if s for w in s}) + ["x"]
        wording = [w.decode() for w in alnum_words(plain(template).encode())]
        for _ in range(30):
            words = [rng.choice(known) for _ in range(rng.randrange(4))] + [w for w in wording if rng.random() > 0.06]
            words += [rng.choice(known) for _ in range(rng.randrange(4))]
            for i in range(len(words)):
                want = max((j - i for j in range(i + 1, len(words) + 1)
                            if rule.fullmatch("".join(w + " " for w in words[i:j]))), default=0)
                assert machine.longest([w.encode() for w in words], i) == want


def test_every_template_accepts_its_wording_and_no_other_word():
    for label, template in licenses.TEMPLATES.items():
        words = alnum_words(plain(template).encode())
        assert label in licenses.scan_text(b" ".join(words))[5].split(",")
        if "<<" not in template:
            for k in range(len(words)):
                assert label not in licenses.scan_text(b" ".join([*words[:k], b"zzz", *words[k + 1:]]))[5].split(",")


def test_bsd_clauses_are_told_apart():
    three = plain(BSD3)
    assert licenses.scan_text(three.encode())[5] == "BSD-3-Clause"
    assert licenses.scan_text(plain(licenses.TEMPLATES["BSD-2-Clause"]).encode())[5] == "BSD-2-Clause"
    assert licenses.scan_text(three[:three.index("THIS SOFTWARE")].encode())[5] == ""


def test_base_places_of_long_texts():
    def brute(words):
        return sorted((i, len(p.split()), label) for p, label in licenses.BASE for i in range(len(words))
                      if words[i:i + len(p.split())] == p.encode().split())

    rng = random.Random(1)
    words = [rng.choice(b"mit license cc by apache gnu general public x".split()) for _ in range(3000)]
    assert sorted(licenses.base_places(b" " + b" ".join(words) + b" ")) == brute(words)
    start = time.time()
    found = licenses.scan_text(b"mit license " * 200_000)
    assert found[:4] == (400_000, 200_000, 0, 399_998) and time.time() - start < 20


def test_scan_table(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "The MIT License, cc by; CC-BY", "c"), (3, "The MIT License, cc by; CC-BY", "c"), (None, "mit license", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = [r[:7] for r in licenses.scan(docs).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert got[0] == got[1][:0] + (1, 0, 0, None, None, "", "") and got[1] == (2, 0, 0, None, None, "", "")
    assert got[2] == got[3] == (3, 7, 3, 1, 5, "cc-by,mit", "cc-by,mit") and got[4] == (None, 2, 1, 0, 0, "mit", "mit")
    assert licenses.scan(docs.limit(0)).count() == 0


def test_items_without_ids_and_many_blocks(spark):
    docs = spark.createDataFrame([(1, "x a b c y d e z"), (2, "nothing"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), ("i", "a b"), (None, "d e"), ("j", None), (None, None)], "item_id string, text string")
    for words in (1_000_000, 1):
        got = decontam.search(docs, items, block_words=words).orderBy("doc_id").collect()
        assert [([tuple(s) for s in r["spans"]], r["items"], r["n_words"]) for r in got] == [([(1, 2), (5, 6)], ["i"], 8), ([], [], 1), ([], [], 0)]
        clean = decontam.clean(docs, items, block_words=words).orderBy("doc_id").collect()
        assert clean[0].text.split() == ["x", "c", "y", "z"] and clean[1].text == "nothing" and clean[2].text is None
    assert decontam.search(docs.limit(0), items).count() == 0
    assert [r["spans"] for r in decontam.search(docs, items.limit(0)).collect()] == [[], [], []]
