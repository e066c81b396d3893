"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, decontaminate, langid, lm, neardup, packing, pipeline, quality, secrets, substrings, toxicity

_QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan, "op2_packing": packing.op2_packing, "op3_quality": quality.op3_quality, "op4_decontamination": decontaminate.op4_decontamination,
    "op5_ann": ann.op5_ann, "op6_suffix_dedup": substrings.op6_suffix_dedup, "op7_toxicity": toxicity.op7_toxicity, "op8_lm": lm.op8_lm, "op9_minhash": neardup.op9_minhash,
    "op10_langid": langid.op10_langid, "pipeline": pipeline.run,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontaminate.OP4_SQL} | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
