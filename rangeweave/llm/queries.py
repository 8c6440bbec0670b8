"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .context_mixing import op5_context_mixing
from .mixing import op6_mixing
from .oracles import ORACLES
from .pieces import op2_sentencepiece
from .probminhash import op1_probminhash
from .quality_classifier import op10_quality_classifier
from .quality_rules import op9_quality_rules
from .token_ids import op7_token_ids
from .substrings import op3_substrings
from .syncmers import op8_syncmers
from .warc import op4_warc

QUERIES = {
    "op1_probminhash": op1_probminhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_substrings": op3_substrings,
    "op4_warc": op4_warc,
    "op5_context_mixing": op5_context_mixing,
    "op6_mixing": op6_mixing,
    "op7_token_ids": op7_token_ids,
    "op8_syncmers": op8_syncmers,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
}

__all__ = ["ORACLES", "QUERIES"]
