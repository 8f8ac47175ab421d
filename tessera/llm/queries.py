"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import pipeline, sharding
from tessera.llm.bpe import op7_byte_bpe
from tessera.llm.fertility import op2_quality_rules
from tessera.llm.jaccard import op8_jaccard_join
from tessera.llm.langid import op10_language_id
from tessera.llm.mixing import op9_mixing
from tessera.llm.neardup import op6_embedding_neardup
from tessera.llm.secrets import op4_secret_scan
from tessera.llm.sharding import op5_jump_sharding
from tessera.llm.toxicity import op1_toxicity
from tessera.llm.warc import op3_warc_derivatives

QUERIES = {
    "pipeline": pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_secret_scan": op4_secret_scan,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_embedding_neardup": op6_embedding_neardup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
}
ORACLES: dict[str, str] = {"op5_jump_sharding": sharding.ORACLE_SQL}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
