"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroid_clustering
from .cube import op13_mixing
from .hnsw import OP9_SQL, op9_embedding_near_dedup
from .jaccard import OP8_SQL, op8_ngram_jaccard_join
from .kneser_ney import op1_quality_classifier
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import op10_lm_scoring
from .packing import op6_best_fit_packing
from .sentence_spans import OP5_SQL, op5_substring_dedup
from .substring_dedup import op3_suffix_array_dedup
from .tiling import op2_decontamination
from .token_counts import op4_token_counts
from .training_order import op7_training_order


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_quality_classifier, op2_decontamination, op3_suffix_array_dedup, op4_token_counts, op5_substring_dedup, op6_best_fit_packing, op7_training_order, op8_ngram_jaccard_join, op9_embedding_near_dedup, op10_lm_scoring,
        op11_centroid_clustering, op12_merkle_manifest, op13_mixing,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op9_embedding_near_dedup": OP9_SQL, "op11_centroid_clustering": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
