"""The queries of the training-data operators: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import copies, encode, leakage, mixture, overlap, packing, sample, seen, split
from quern.plans.runtime import read, ship_package


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return operator(*(read(spark, sf_dir, t) for t in tables))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _on(overlap.found, "documents"),
        "p1_report": _on(overlap.report, "documents"),
        "p2_sample": _on(sample.sample, "documents"),
        "p2_growth": _on(sample.growth, "documents"),
        "p2_stability": _on(sample.stability, "documents"),
        "p3_found": _on(lambda d: copies.form_copies(d)[1], "documents"),
        "p3_copies": _on(lambda d: copies.form_copies(d)[0], "documents"),
        "p4_found": _on(leakage.found, "documents", "benchmark"),
        "p4_items": _on(leakage.by_item, "documents", "benchmark"),
        "p4_spans": _on(leakage.leaks, "documents", "benchmark"),
        "p4_word_spans": _on(leakage.word_spans_of, "documents", "benchmark"),
        "p4_removed": _on(leakage.removed, "documents", "benchmark"),
        "p5_windows": _on(packing.pack, "token_docs", "size_limits"),
        "p5_room": _on(packing.room, "token_docs", "size_limits"),
        "p5_totals": _on(packing.totals, "token_docs", "size_limits"),
        "p6_found": _on(seen.found, "ngram_hashes", "ngram_index", "documents"),
        "p6_error_rates": _on(seen.error_rates, "ngram_hashes", "ngram_index", "documents"),
        "p6_totals": _on(seen.totals, "ngram_hashes", "ngram_index", "documents"),
        "p7_ids": _on(encode.encode, "documents"),
        "p7_round_trip": _on(encode.round_trip, "documents"),
        "p7_decoded": _on(encode.decoded, "documents"),
        "p8_mixture": _on(mixture.documents_mixed, "documents", "mix_targets"),
        "p8_shares": _on(mixture.shares, "documents", "mix_targets"),
        "p8_residuals": _on(mixture.residuals, "documents", "mix_targets"),
        "p8_checks": _on(mixture.checks, "documents", "mix_targets"),
        "p9_pieces": _on(split.pieces, "documents", "size_limits"),
        "p9_checks": _on(split.checks, "documents", "size_limits"),
    }
