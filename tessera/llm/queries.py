"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import oracle, topk
from tessera.llm.attention import op9_lm_score
from tessera.llm.bpe import op3_bpe
from tessera.llm.language import op8_language
from tessera.llm.minhash import op6_near_duplicates
from tessera.llm.mixing import op1_mixing
from tessera.llm.quality import op4_quality
from tessera.llm.substrings import op5_repeated_bytes
from tessera.llm.token_files import op2_token_files
from tessera.llm.topk import op7_top_k
from tessera.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_files, op3_bpe, op4_quality, op5_repeated_bytes, op6_near_duplicates, op7_top_k, op8_language, op9_lm_score, op10_toxicity)}

ORACLE_SQL: dict[str, str] = {"op5_repeated_bytes": oracle.REPEATED_BYTES, "op6_near_duplicates": oracle.NEAR_DUPLICATES, "op7_top_k": topk.ORACLE_SQL}
