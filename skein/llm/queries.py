"""The opN_ queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_format
from .decontaminate import OP4_SQL, op4_decontamination
from .fingerprint import OP7_SQL, op7_fingerprint
from .licences import op9_licence_scan, op9_sql
from .line_dedup import OP3_SQL, op3_line_dedup
from .ngram_join import op1_ngram_join
from .packing import op2_packing
from .pii import op10_pii
from .quality import op5_quality
from .secret_scan import op6_secret_scan


def queries() -> dict:
    ops = (op1_ngram_join, op2_packing, op3_line_dedup, op4_decontamination, op5_quality, op6_secret_scan, op7_fingerprint, op8_chat_format, op9_licence_scan, op10_pii)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_fingerprint": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_licence_scan": op9_sql()}
