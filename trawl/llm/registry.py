"""The operators' queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from trawl.llm import byte_bpe, chat_format, decontaminate, licenses, near_dedup, quality_classifier, quality_rules, secrets, suffix_dedup, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        quality_classifier.op1_quality_classifier,
        near_dedup.op2_near_dedup,
        licenses.op3_license_scan,
        url_filter.op4_url_filter,
        chat_format.op5_preference_format,
        suffix_dedup.op6_suffix_dedup,
        decontaminate.op7_decontaminate,
        quality_rules.op8_quality_rules,
        secrets.op9_secret_scan,
        byte_bpe.op10_byte_bpe,
    )
}

ORACLES = {"op3_license_scan": licenses.oracle_sql(), "op5_preference_format": chat_format.oracle_sql(), "op6_suffix_dedup": suffix_dedup.oracle_sql()}


def _part(name: str, *columns: str):
    return lambda spark, sf_dir: QUERIES[name](spark, sf_dir).select(*columns)


#: Columns of a query that SQL can express though not the whole, as queries of their own.
for _name, _columns, _sql in (
    ("op4_url_filter", ["page_id", "host", "path", "rule"], url_filter.rules_sql()),
    ("op8_quality_rules", ["doc_id", *quality_rules.STATS, "base_failed"], quality_rules.base_sql()),
    ("op9_secret_scan", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], secrets.base_sql()),
):
    QUERIES[f"base_of_{_name}"], ORACLES[f"base_of_{_name}"] = _part(_name, *_columns), _sql
