"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from swellframe.llm import decontam, html_text, lexical, line_dedup, mixing, near_dup, pii, quality, secret_scan, token_output, topk, toxicity, whitening
from swellframe.llm.common import crc_text, table


def _remainder(n: int):
    return F.pmod(crc_text(F.col("doc_id")), F.lit(n))


def op1_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(_remainder(4) != 2))
    got = quality.score(docs, model)
    return got.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op2_tokens(spark, sf_dir):
    return token_output.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_lines(spark, sf_dir):
    return line_dedup.drop_lines(table(spark, sf_dir, "documents"))


def op4_minhash(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op5_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.weighted(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(_remainder(5) != 0))
    got = toxicity.score(docs, model)
    return got.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op8_decontam(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_secrets(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op12_lexical(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


_QUERIES = (op1_quality, op2_tokens, op3_lines, op4_minhash, op5_pii, op6_mixing, op7_toxicity, op8_decontam, op9_topk, op10_html, op11_secrets, op12_lexical, op13_whitening)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {"op3_lines": line_dedup.ORACLE, "op4_minhash": near_dup.ORACLE, "op8_decontam": decontam.ORACLE, "op9_topk": topk.ORACLE, "op11_secrets": secret_scan.ORACLE, "op12_lexical": lexical.ORACLE}
