"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op2_decontaminate
from .embeddings import op4_embeddings
from .filter_audit import op12_filter_audit
from .licenses import op3_licenses
from .negatives import op13_hard_negatives
from .oracles import ORACLES
from .order_minhash import op11_order_minhash
from .packing import op9_packing
from .quality import op8_quality
from .secrets import op1_secrets
from .simhash import op7_simhash
from .suffixes import op5_repeats
from .tokenfile import op6_token_file
from .toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (op1_secrets, op2_decontaminate, op3_licenses, op4_embeddings, op5_repeats, op6_token_file, op7_simhash, op8_quality, op9_packing, op10_toxicity, op11_order_minhash, op12_filter_audit, op13_hard_negatives)}
__all__ = ["ORACLES", "QUERIES"]
