"""Queries of this subpackage over the project's tables. None can be said in SQL; tests/llm holds them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlink.llm.linkage import matched_establishments
from ledgerlink.llm.names import entity_pairs, named_entities
from ledgerlink.llm.packing import packed_documents
from ledgerlink.llm.quality import text_quality
from ledgerlink.llm.tokens import token_ids
from ledgerlink.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_pairs(table(spark, sf_dir, "name_entry"))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry that names somebody, with its entity."""
    return named_entities(table(spark, sf_dir, "name_entry"))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their confidence."""
    return matched_establishments(*(table(spark, sf_dir, t) for t in ("extraction", "etablissement", "commune")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("row_id", "siret")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics, the distance from prose and the kind of each document."""
    return text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_quality(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


def queries() -> dict:
    return {"p3_found": p3_found, "p3_entities": p3_entities, "p5_found": p5_found, "p5_matches": p5_matches, "p6_ids": p6_ids, "p7_packs": p7_packs, "p8_found": p8_found, "p8_quality": p8_quality}


def oracle_sql() -> dict[str, str]:
    return {}
