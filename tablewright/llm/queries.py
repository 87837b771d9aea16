"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from .embedding_copies import op12_embedding_copies
from .fingerprints import op9_fingerprints
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .mixing import OP8_SQL, op8_mixing
from .ngram_join import op6_ngram_jaccard
from .packing import op1_packing
from .periodic_runs import op13_periodic_runs
from .personal_data import op4_personal_data
from .quality_classifier import op5_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .sharding import op2_sharding
from .token_counts import op10_token_counts
from .toxicity import op7_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_sharding, op3_quality_rules, op4_personal_data, op5_quality_classifier,
        op6_ngram_jaccard, op7_toxicity, op8_mixing, op9_fingerprints, op10_token_counts,
        op11_hard_negatives, op12_embedding_copies, op13_periodic_runs,
    )
}
SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op8_mixing": OP8_SQL, "op11_hard_negatives": OP11_SQL}
