"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from docloom.llm import decontaminate, html_text, license_scan, near_dup, packing, quality_rules, secret_scan, token_counts, toxicity, warc


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_quality_rules": quality_rules.query,
        "op2_license_scan": license_scan.query,
        "op3_packing": packing.query,
        "op4_warc": warc.query,
        "op5_near_dup": near_dup.query,
        "op6_html_text": html_text.query,
        "op7_toxicity": toxicity.query,
        "op8_decontaminate": decontaminate.query,
        "op9_token_counts": token_counts.query,
        "op10_secret_scan": secret_scan.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.sql(), "op4_warc": warc.sql()}
