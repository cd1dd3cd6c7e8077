from pyspark.sql import functions as F

from wordloom.functions import text as tx


def _tok(spark, s, **kw):
    df = spark.createDataFrame([(s,)], "t string")
    return df.select(tx.tokenize("t", **kw).alias("x")).first()["x"]


def test_case_and_punctuation(spark):
    assert _tok(spark, "ÉCLAIR-no. 7 (Two)", lowercase=True, strip_punctuation=True) == ["éclairno", "7", "two"]


def test_framed_document_and_back(spark):
    """Nested angle brackets, tags at a text's edges and side by side, digits beside a tag, non-ASCII runs, an empty section."""
    sections = {"input": "<<i>>9</i>zwölf\tΩmega", "context": "", "output": "<end_1><-2>7% a</b c"}
    df = spark.createDataFrame([sections], "input string, context string, output string")
    framed = tx.tokenize_document(keep_whitespace=True)
    assert df.select(framed.alias("t")).first()["t"] == [
        "<input>", "<", "<i>", ">", "9", "</i>", "zwölf", "\t", "Ωmega", "</input>", "<context>", "</context>",
        "<output>", "<end_1>", "<-2>", "7", "%", " ", "a", "<", "/", "b", " ", "c", "</output>"]
    back = df.select(tx.detokenize(framed).alias("d")).first()["d"]
    assert {k: back[k] for k in sections} == sections


def test_edge_cases(spark):
    cases = {
        "<": ["<"], "</": ["<", "/"], "<>": ["<>"], "</>": ["</>"], "a<b>c": ["a", "<b>", "c"],
        "x y": ["x", " ", "y"],
        "café naïve \U0001F600\U00010400z": ["café", " ", "naïve", " ", "\U0001F600", "\U00010400z"],
        "Ⅷ ½": ["Ⅷ", " ", "½"],
        "l’eau": ["l", "’", "eau"],
        "áb": ["a", "́", "b"],
        "हिन": ["हिन"],
        "": [],
    }
    for s, want in cases.items():
        assert _tok(spark, s, keep_whitespace=True) == want, s


def test_whitespace_dropped_by_default(spark):
    assert _tok(spark, "a  b\t<c>\n d") == ["a", "b", "<c>", "d"]
    df = spark.createDataFrame([(["a", " ", "b", "　"],)], "t array<string>")
    assert df.select(tx.drop_whitespace_tokens("t").alias("x")).first()["x"] == ["a", "b"]


def test_strip_runs_before_scanning(spark):
    # user tags become bare words, apostrophes vanish
    assert _tok(spark, "<b>don't</b> x", strip_punctuation=True) == ["bdontb", "x"]


def test_detokenize_malformed_is_null(spark):
    rows = [(["<input>", "a", "</input>", "<context>", "</context>"],),
            (["<output>", "x", "</output>"],),
            (["<input>", "</input>", "<context>", "</context>", "<output>", "</output>", "tail"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    out = [r["d"] for r in df.select(tx.detokenize("t").alias("d")).collect()]
    assert out[0] is None and out[1] is None
    assert (out[2]["input"], out[2]["context"], out[2]["output"]) == ("", "", "")


def test_normalize(spark):
    df = spark.createDataFrame([("A-b, C!",)], "t string")
    assert df.select(tx.normalize("t", True, True).alias("x")).first()["x"] == "ab c"
