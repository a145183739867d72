"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import audio, bpe, filter_audit, language_id, mixing, near_dedup, pii, secret_scan, spelling, token_counts, topk, url_filter, warc


def queries() -> dict:
    return {
        "op1_audio_features": audio.op1_audio_features,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_language_id": language_id.op3_language_id,
        "op4_pii": pii.op4_pii,
        "op5_exact_top_k": topk.op5_exact_top_k,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_warc": warc.op8_warc,
        "op9_bpe": bpe.op9_bpe,
        "op10_mixing": mixing.op10_mixing,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_url_filter": url_filter.op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": topk.SQL, "op7_near_dedup": near_dedup.SQL, "op8_warc": warc.SQL, "op10_mixing": mixing.SQL, "op11_spelling_variants": spelling.SQL, "op12_filter_audit": filter_audit.SQL, "op13_url_filter": url_filter.SQL}
