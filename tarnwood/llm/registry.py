"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .bpe import op5_bpe_round_trip
from .decontaminate import op1_lsa_decontamination
from .exact_dedup import OP3_SQL, op3_grace_dedup
from .licenses import op10_license_scan
from .line_dedup import op4_template_lines
from .lm import op9_lm_bloom
from .minhash import op7_minhash_bayes
from .packing import op11_nnls_packing
from .pii import op2_pii_semicrf
from .toxicity import op8_toxicity_mil
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP6_SQL, op6_warc_revisits

_QUERIES = (
    op1_lsa_decontamination,
    op2_pii_semicrf,
    op3_grace_dedup,
    op4_template_lines,
    op5_bpe_round_trip,
    op6_warc_revisits,
    op7_minhash_bayes,
    op8_toxicity_mil,
    op9_lm_bloom,
    op10_license_scan,
    op11_nnls_packing,
    op12_token_alignment,
    op13_vector_codes,
)


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_grace_dedup": OP3_SQL, "op6_warc_revisits": OP6_SQL, "op13_vector_codes": OP13_SQL}
