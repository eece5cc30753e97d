"""The queries of this subpackage; none has an SQL twin, they are tested against brute force and held-out cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trajlake.llm import boilerplate, leakage, packing, pairs, pii, splits, subjects, toxicity, truncation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": boilerplate.p1_found,
        "p1_kinds": boilerplate.p1_kinds,
        "p2_found": pairs.p2_found,
        "p3_found": truncation.p3_found,
        "p3_rates": truncation.p3_rates,
        "p4_found": pii.p4_found,
        "p4_clean": pii.p4_clean,
        "p5_found": boilerplate.p5_found,
        "p5_text": boilerplate.p5_text,
        "p6_found": toxicity.p6_found,
        "p6_rates": toxicity.p6_rates,
        "p7_found": splits.p7_found,
        "p7_splits": splits.p7_splits,
        "p8_containers": packing.p8_containers,
        "p8_fill": packing.p8_fill,
        "p8_batches": packing.p8_batches,
        "p9_found": leakage.p9_found,
        "p9_spans": leakage.p9_spans,
        "p10_found": subjects.p10_found,
        "p10_shares": subjects.p10_shares,
    }


def oracle_sql() -> dict[str, str]:
    return {}
