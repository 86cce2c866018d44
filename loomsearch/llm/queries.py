"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import embeddings, html, langid, licenses, packing, pieces, pii, quality, secrets, simhash


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_pii": pii.op3_pii,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_html_extraction": html.op5_html_extraction,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_language_id": langid.op7_language_id,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.oracle()}
