"""Queries of the token operators.  SQL has no tokenizers: tests hold them against the libraries, text by text."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunked_bpe import decode_ids, encode_ids
from .common import table
from .packing import pack
from .registry import query
from .token_counts import token_counts
from .token_files import read_ids, write_ids


@query()
def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_ids(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_ids(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode_ids(table(spark, folder, "documents"), path, pattern)
    return decode_ids(coded, path, pattern).drop("decoded")


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)


@query()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
