"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontam, fim, ids, lang, licence, neardup, phrases, quality, secrets, substring, toxicity, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_bpe": bpe.op2_bpe,
        "op3_quality": quality.op3_quality,
        "op4_ids": ids.op4_ids,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_decontam": decontam.op6_decontam,
        "op7_substring": substring.op7_substring,
        "op8_secrets": secrets.op8_secrets,
        "op9_lang": lang.op9_lang,
        "op10_neardup": neardup.op10_neardup,
        "op11_licence": licence.op11_licence,
        "op12_phrases": phrases.op12_phrases,
        "op13_fim": fim.op13_fim,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.OP1_SQL, "op6_decontam": decontam.OP6_SQL, "op7_substring": substring.OP7_SQL, "op11_licence": licence.OP11_SQL, "op12_phrases": phrases.OP12_SQL, "op13_fim": fim.OP13_SQL}
