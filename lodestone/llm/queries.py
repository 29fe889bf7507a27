"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lodestone.llm import exact_dedup, langid, media, minhash, mixing, pii, quality, sentencepiece_codec, substring, token_output

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_pii": pii.op2_pii,
    "op3_language": langid.op3_language,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": minhash.op5_near_dedup,
    "op6_quality": quality.op6_quality,
    "op7_passages": substring.op7_passages,
    "op8_media": media.op8_media,
    "op9_mix": mixing.op9_mix,
    "op10_token_ids": token_output.op10_token_ids,
}
ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_near_dedup": minhash.ORACLE_SQL,
    "op7_passages": substring.ORACLE_SQL,
}
