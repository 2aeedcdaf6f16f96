"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from seekwell.llm.gif import gif_timed_frames, op9_gif_media
from seekwell.llm.itq import op11_itq_near_vectors
from seekwell.llm.merkle import OP13_SQL, op13_merkle_versions
from seekwell.llm.mixing import OP8_SQL, op8_mix_hash_threshold
from seekwell.llm.packing import op5_best_fit_packing
from seekwell.llm.preferences import OP4_SQL, op4_preference_pairs
from seekwell.llm.prefix_trie import OP12_SQL, op12_prefix_trie_euler
from seekwell.llm.quality import op10_quality_llr
from seekwell.llm.sharding import OP6_SQL, op6_extendible_shards
from seekwell.llm.simhash import op2_simhash_golay
from seekwell.llm.suffix_array import op1_suffix_array_dedup, repeat_groups_of_documents
from seekwell.llm.suffix_automaton import op7_suffix_automaton_dedup
from seekwell.llm.urls import OP3_SQL, op3_bloom_cascade

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_simhash_golay": op2_simhash_golay,
    "op3_bloom_cascade": op3_bloom_cascade,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_extendible_shards": op6_extendible_shards,
    "op7_suffix_automaton_dedup": op7_suffix_automaton_dedup,
    "op8_mix_hash_threshold": op8_mix_hash_threshold,
    "op9_gif_media": op9_gif_media,
    "op10_quality_llr": op10_quality_llr,
    "op11_itq_near_vectors": op11_itq_near_vectors,
    "op12_prefix_trie_euler": op12_prefix_trie_euler,
    "op13_merkle_versions": op13_merkle_versions,
    "gif_timed_frames": gif_timed_frames,
    "repeat_groups": repeat_groups_of_documents,
}

ORACLES: dict[str, str] = {
    "op3_bloom_cascade": OP3_SQL,
    "op4_preference_pairs": OP4_SQL,
    "op6_extendible_shards": OP6_SQL,
    "op8_mix_hash_threshold": OP8_SQL,
    "op12_prefix_trie_euler": OP12_SQL,
    "op13_merkle_versions": OP13_SQL,
}
