"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, divergence, fmindex, jaccard, mixing, resampling
from .chat import op4_chat
from .counting import op12_counts
from .divergence import op11_divergence
from .fmindex import op6_decontaminate
from .jaccard import op5_jaccard
from .lines import op7_lines
from .mixing import op2_mixing
from .pii import op8_pii
from .quality import op3_quality
from .resampling import op13_resampling
from .tiff import op1_tiff
from .tokens import op9_tokens
from .warc import op10_warc

QUERIES = {
    "op1_tiff": op1_tiff,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_jaccard": op5_jaccard,
    "op6_decontaminate": op6_decontaminate,
    "op7_lines": op7_lines,
    "op8_pii": op8_pii,
    "op9_tokens": op9_tokens,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_counts": op12_counts,
    "op13_resampling": op13_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op4_chat": chat.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op6_decontaminate": fmindex.ORACLE,
    "op11_divergence": divergence.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
