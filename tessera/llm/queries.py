"""Registry of the training-data queries: name -> callable, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op9_bpe
from .chat import OP6_SQL, op6_chat
from .decontam import op4_decontaminate
from .html_text import op3_html
from .langid import op7_langid
from .packing import op5_packing
from .pii import op10_pii
from .quality import op1_quality
from .simhash import op8_simhash
from .toxicity import op2_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_chat": op6_chat,
    "op7_langid": op7_langid,
    "op8_simhash": op8_simhash,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {"op6_chat": OP6_SQL}
