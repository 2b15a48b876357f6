"""Queries of the corpus operators and their DuckDB SQL, one ``opN_<name>`` an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import dedup, html_text, licenses, merges, neighbours, packing, pieces, quality, resample, secrets, spelling, tokens, warc
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_piece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.n_best(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), n=4, ids_as="binary")


def op2_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op3_pack_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit_field(docs, table(spark, sf_dir, "labels")))


def op8_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op6_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), queries="vec_id % 20 = 0")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op11_crc_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.code(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_n_best": op1_piece_n_best,
    "op2_odd_sketch_dedup": op2_odd_sketch_dedup,
    "op3_pack_swap": op3_pack_swap,
    "op4_warc_salvage": op4_warc_salvage,
    "op5_crf_quality": op5_crf_quality,
    "op8_host_suffix_text": op8_host_suffix_text,
    "op9_license_dice": op9_license_dice,
    "op10_secret_layers": op10_secret_layers,
    "op6_multiprobe": op6_multiprobe,
    "op7_token_counts": op7_token_counts,
    "op11_crc_resample": op11_crc_resample,
    "op12_trie_variants": op12_trie_variants,
    "op13_merge_queue": op13_merge_queue,
}

ORACLES: dict[str, str] = {"op9_license_dice": licenses.oracle(), "op11_crc_resample": resample.oracle(), "op12_trie_variants": spelling.oracle()}
