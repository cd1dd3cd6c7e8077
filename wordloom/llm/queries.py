"""Registered queries ``opN_*`` of this subpackage: thin digests of the operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import align, bpe, decontam, jaccard, language, licenses, lines, packing, pages, quality, rans, substrings, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents")).drop("spans")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.train(docs.filter(~F.col("held_out")))
    rows = docs.select(F.struct("doc_id", "held_out").alias("k"), "text")
    return language.identify(rows, model, id_col="k").select("k.doc_id", "k.held_out", "lang_pred", "score")


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.fresh_folder(spark, "ids")
    rans.write_ids(rans.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return rans.read_digests(spark, path)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(variants.word_counts(_table(spark, sf_dir, "documents")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = materialize(packing.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return packing.pack(tokens).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_license_scan, op3_quality_rules, op4_bpe, op5_language_id, op6_wrapper_induction, op7_parity_join,
    op8_decontamination, op9_line_dedup, op10_token_files, op11_spelling_variants, op12_packing, op13_token_alignment)}

#: crc32 of ``<doc_id>:<run>`` byte by byte; runs hold a-z and U+00C0 to U+00FF, whose UTF-8 is C3 and the code point less 64.
_CRC = """
tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
        FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
byte AS (SELECT doc_id, run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM low),
hashed AS (SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
           FROM byte, tab)"""

SQL: dict[str, str] = {
    "op11_spelling_variants": f"""WITH RECURSIVE {_CRC},
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run))
          || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
masked AS (SELECT word, n, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS mask FROM places),
less AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS cut FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
         UNION ALL SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.cut
         UNION ALL SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.cut),
ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 2 * w.n THEN r.other END AS form,
           CASE WHEN r.other_n >= 2 * w.n THEN r.other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (SELECT word, word AS at, form FROM formed
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.form IS NULL""",
}
