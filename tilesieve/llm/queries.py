"""The queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilesieve.llm import bpe, exact_dedup, license_scan, line_dedup, packing, quality_fm, quality_rules, simhash, sql, url_filter, warc
from tilesieve.llm.common import table

URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_line_dedup(spark, sf_dir):
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op3_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.mark(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("n_failed_lines")


def op6_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def op9_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_line_dedup,
        op3_url_filter,
        op4_exact_dedup,
        op5_quality_rules,
        op6_license_scan,
        op7_warc,
        op8_byte_bpe,
        op9_simhash_dedup,
        op10_quality_classifier,
    )
}
SQL = {
    "op2_line_dedup": sql.OP2,
    "op3_url_filter": sql.op3(URL_RULES),
    "op4_exact_dedup": sql.OP4,
    "op5_quality_rules": sql.OP5,
    "op6_license_scan": sql.OP6,
    "op7_warc": sql.OP7,
}
