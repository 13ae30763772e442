"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from .chat_format import OP3_SQL, op3_chat_format
from .conversation_repair import op11_conversation_repair
from .decontaminate import op1_decontaminate
from .mixing import op4_source_mixing
from .near_dup import op8_near_dup
from .quality import op5_quality
from .secret_scan import op12_secret_scan
from .substring_dedup import op2_substring_dedup
from .token_counts import op9_token_counts
from .topk import OP10_SQL, op10_topk
from .toxicity import op6_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP7_SQL, op7_warc


def queries() -> dict:
    made = (
        op1_decontaminate, op2_substring_dedup, op3_chat_format, op4_source_mixing, op5_quality, op6_toxicity, op7_warc, op8_near_dup, op9_token_counts, op10_topk,
        op11_conversation_repair, op12_secret_scan, op13_vector_codes,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": OP3_SQL, "op7_warc": OP7_SQL, "op10_topk": OP10_SQL, "op13_vector_codes": OP13_SQL}
