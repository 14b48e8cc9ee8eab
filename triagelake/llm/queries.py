"""The subpackage's registered queries and their DuckDB twins."""

from __future__ import annotations

from . import pipeline
from .op1_mixing import op1_mix_entropy
from .op2_language import op2_lang_kernel
from .op3_wu_manber import OP3_SQL, op3_wu_manber
from .op4_parity import op4_parity_join
from .op5_toxicity import op5_toxicity_nb
from .op6_suffix import op6_suffix_dedup
from .op7_url_tree import op7_url_tree
from .op8_license import op8_license_digest
from .op9_chat import op9_chat_hmm
from .op10_graph import op10_flat_graph
from .op11_vptree import OP11_SQL, op11_vp_clusters
from .op12_bpe import op12_bpe_codec
from .op13_merkle import OP13_SQL, op13_merkle_manifest
from .twins import MIX_TARGETS_SQL, OP4_SQL, OP6_SQL, OP10_SQL, URL_RULES_SQL, mix_targets, url_rules

QUERIES = {
    "op1_mix_entropy": op1_mix_entropy,
    "op2_lang_kernel": op2_lang_kernel,
    "op3_wu_manber": op3_wu_manber,
    "op4_parity_join": op4_parity_join,
    "op5_toxicity_nb": op5_toxicity_nb,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_tree": op7_url_tree,
    "op8_license_digest": op8_license_digest,
    "op9_chat_hmm": op9_chat_hmm,
    "op10_flat_graph": op10_flat_graph,
    "op11_vp_clusters": op11_vp_clusters,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_merkle_manifest": op13_merkle_manifest,
    "mix_targets": mix_targets,
    "url_rules": url_rules,
    "pipeline": pipeline.run,
}

ORACLE = {
    "op3_wu_manber": OP3_SQL,
    "op4_parity_join": OP4_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op10_flat_graph": OP10_SQL,
    "mix_targets": MIX_TARGETS_SQL,
    "url_rules": URL_RULES_SQL,
    "op11_vp_clusters": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
