"""Queries opN_<name> over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, conversations, decontaminate, host_rules, level_packing, lines, main_text, merkle, packing, secrets, simhash, substrings, token_files, warc


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(common.table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = common.shared_dir(spark)
    manifest = token_files.write_token_files(common.table(spark, sf_dir, "documents"), out)
    return token_files.digest(spark, out, manifest)


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.report(common.table(spark, sf_dir, "documents"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(common.table(spark, sf_dir, "pages"), common.shared_dir(spark))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(common.table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(common.table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(common.table(spark, sf_dir, "documents"))


def op10_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_packing.digest(level_packing.pack(common.table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(common.table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(common.table(spark, sf_dir, "conversations"))


_ALL = (
    op1_main_text, op2_token_files, op3_host_rules, op4_simhash_near_duplicates, op5_warc_archives, op6_line_runs, op7_best_fit_packing, op8_repeated_substrings, op9_secret_scan, op10_benchmark_items,
    op11_sum_of_squares_packing, op12_merkle_manifest, op13_conversation_repair,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op3_host_rules": host_rules.ORACLE_SQL, "op5_warc_archives": warc.ORACLE_SQL, "op6_line_runs": lines.ORACLE_SQL, "op8_repeated_substrings": substrings.ORACLE_SQL, "op10_benchmark_items": decontaminate.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_conversation_repair": conversations.ORACLE_SQL}
