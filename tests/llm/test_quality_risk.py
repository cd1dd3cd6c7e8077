"""Cutoffs of the quality rules: order, choice and risk over all rules of a stratum."""

import numpy as np

from wordloom.llm import quality


def test_sequence_and_choice():
    every, bad = ({r: np.zeros(quality.BINS + 1, np.int64) for r in quality.RULES} for _ in range(2))
    every["symbols"][[0, 10, 50]], bad["symbols"][[0, 10, 50]] = (80, 10, 10), (0, 1, 9)
    every["upper"][[0, 30]], bad["upper"][[0, 30]] = (90, 10), (5, 5)
    order = quality.sequence(every, bad)
    first = [order.index(x) for x in (("symbols", 50), ("upper", 30), ("symbols", 10))]
    assert first == sorted(first) and ("symbols", 9) not in order and ("bangs", 5) not in order
    assert [b for r, b in order if r == "symbols"] == list(range(quality.BINS, 9, -1))
    good, fell = np.array([0, 1, 40, 959]), np.array([50, 30, 20, 0])
    assert quality.choose(good, fell, 0.02, 0.01) == 2             # 1 of 1000 good ones fall, 80 bad ones; the third step fails
    assert quality.choose(good // 20, fell, 0.02, 0.01) == 0       # too few labels
    assert quality.choose(good * 0, fell, 0.02, 0.01) == 0 and quality.choose(good, fell * 0, 0.02, 0.01) == 0


def test_risk_holds_for_all_rules_together(spark):
    """Each rule alone would cost few good documents, all five together too many."""
    text = " ".join(f"word{i}" for i in range(60))
    marks = ["#" * 60, " " + "A" * 200, " !" * 20, "\nx\nx\nx", " p q r p q r p q r"]
    rows = [(i, text + (marks[i % 5] if i % 1000 < 60 else "")) for i in range(4000)] + [(i, text + marks[i % 5]) for i in range(4000, 4500)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 4000)) for i, _ in rows], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels, risk=0.03).collect()}
    assert 0 < sum(not kept[i] for i in range(4000)) <= 120
    assert sum(not kept[i] for i in range(4000, 4500)) >= 100


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "en"), (1, "a " * 60, "en"), (None, " ".join(map(str, range(70))), None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(docs, none).collect()
    assert sorted((r.base_failed, r.kept) for r in got) == [(False, True), (True, False), (True, False)]
    assert quality.judge(docs.limit(0), none).count() == 0
