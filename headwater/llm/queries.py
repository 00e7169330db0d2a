"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat
from .bpe import op4_prefix_bpe
from .compression import op7_compression_quality
from .fertility import op10_tokeniser_fertility
from .imatch import op3_imatch
from .lm import op6_cross_entropy_difference
from .packing import op8_best_fit_packing
from .secrets import op9_secret_scan
from .simhash import op5_simhash_near_dedup
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_snapshots,
        op2_toxicity,
        op3_imatch,
        op4_prefix_bpe,
        op5_simhash_near_dedup,
        op6_cross_entropy_difference,
        op7_compression_quality,
        op8_best_fit_packing,
        op9_secret_scan,
        op10_tokeniser_fertility,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_snapshots": chat.ORACLE_SQL}
