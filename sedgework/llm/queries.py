"""The queries of this subpackage, and their SQL where SQL can express them."""

from sedgework.llm import tool_calls
from sedgework.llm.dual_tree import op12_dual_tree_negatives
from sedgework.llm.hash_forest import op6_hash_prefix_forest
from sedgework.llm.html_wrapper import op4_html_wrapper
from sedgework.llm.jaccard_join import op10_ngram_jaccard_join
from sedgework.llm.langid import op1_language_id
from sedgework.llm.lz_fingerprint import op9_lz_fingerprints
from sedgework.llm.packing import op7_best_fit_packing
from sedgework.llm.periodic_runs import op11_periodic_runs
from sedgework.llm.sampled_pieces import op3_sampled_pieces
from sedgework.llm.source_mix import op13_source_mix
from sedgework.llm.suffix_dedup import op2_suffix_dedup
from sedgework.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_suffix_dedup, op3_sampled_pieces, op4_html_wrapper, op5_toxicity, op6_hash_prefix_forest,
    op7_best_fit_packing, tool_calls.op8_tool_call_linking, op9_lz_fingerprints, op10_ngram_jaccard_join,
    op11_periodic_runs, op12_dual_tree_negatives, op13_source_mix,
)}

SQL = {"op8_tool_call_linking": tool_calls.SQL}
