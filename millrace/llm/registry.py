"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontam, lines, minhash, suffix
from .ann import op3_ann
from .bpe import op8_bpe
from .langid import op10_langid
from .lm import op2_lm
from .secrets import op7_secrets
from .suffix import op5_suffix

QUERIES = {
    "op1_near_dedup": minhash.op1_near_dedup, "op2_lm": op2_lm, "op3_ann": op3_ann, "op4_line_dedup": lines.op4_line_dedup, "op5_suffix": op5_suffix,
    "op6_chat": chat.op6_chat, "op7_secrets": op7_secrets, "op8_bpe": op8_bpe, "op9_decontam": decontam.op9_decontam, "op10_langid": op10_langid,
}
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": minhash.ORACLE, "op4_line_dedup": lines.oracle(), "op5_suffix": suffix.ORACLE, "op6_chat": chat.ORACLE, "op9_decontam": decontam.ORACLE}
