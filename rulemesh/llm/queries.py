"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op13_transducer_bpe
from .divergence import op2_distribution_divergence
from .licences import op3_suffix_automaton_licences
from .mixing import OP10_SQL, op10_low_discrepancy_mix
from .packing import op9_best_fit_packing
from .parsing import op5_locally_consistent_parsing
from .pii import op6_keyed_surrogates
from .quality import op4_boosted_tree_quality
from .ranked_search import OP12_SQL, op12_threshold_search
from .resampling import OP11_SQL, op11_importance_resampling
from .sharding import op8_prefix_sum_shards
from .simhash import op7_simhash_trie_join
from .urls import op1_path_template_tree

QUERIES = {
    "op1_path_template_tree": op1_path_template_tree,
    "op2_distribution_divergence": op2_distribution_divergence,
    "op3_suffix_automaton_licences": op3_suffix_automaton_licences,
    "op4_boosted_tree_quality": op4_boosted_tree_quality,
    "op5_locally_consistent_parsing": op5_locally_consistent_parsing,
    "op6_keyed_surrogates": op6_keyed_surrogates,
    "op7_simhash_trie_join": op7_simhash_trie_join,
    "op8_prefix_sum_shards": op8_prefix_sum_shards,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_low_discrepancy_mix": op10_low_discrepancy_mix,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_threshold_search": op12_threshold_search,
    "op13_transducer_bpe": op13_transducer_bpe,
}

ORACLES: dict[str, str] = {
    "op10_low_discrepancy_mix": OP10_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_threshold_search": OP12_SQL,
}
