"""The operators' queries, and their SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op6_decontamination
from .isolation import op5_isolation_forest
from .language import op2_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .mixing import mix_overlapping_sources, op1_mixing
from .pii import op10_pii_sanitise
from .sharding import op8_sharding
from .simhash import op7_simhash
from .tokens import op4_repair_tokens
from .warc import OP3_SQL, op3_warc_revisits

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_warc_revisits": op3_warc_revisits,
    "op4_repair_tokens": op4_repair_tokens,
    "op5_isolation_forest": op5_isolation_forest,
    "op6_decontamination": op6_decontamination,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_line_dedup": op9_line_dedup,
    "op10_pii_sanitise": op10_pii_sanitise,
    "mix_overlapping_sources": mix_overlapping_sources,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_revisits": OP3_SQL,
    "op9_line_dedup": OP9_SQL,
}
