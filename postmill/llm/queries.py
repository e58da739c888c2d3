"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .chosen_path import op6_jaccard_join
from .conversation_trie import OP13_SQL, op13_prefix_trie
from .decontaminate import OP5_SQL, op5_decontaminate
from .fingerprint import op2_fingerprints
from .langid import op1_language
from .licences import OP4_SQL, op4_licences
from .pii import op7_pii
from .repeats import OP11_SQL, op11_substring_dedup
from .secret_scan import op8_secrets
from .soft_mixing import op10_soft_mixing
from .spelling import OP12_SQL, op12_spelling_variants
from .suffix_tree import op3_lm_scores
from .zip_warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_language": op1_language,
    "op2_fingerprints": op2_fingerprints,
    "op3_lm_scores": op3_lm_scores,
    "op4_licences": op4_licences,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_soft_mixing": op10_soft_mixing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Where SQL cannot express a query, tests/llm hold it against a brute-force version.
ORACLES = {
    "op4_licences": OP4_SQL,
    "op5_decontaminate": OP5_SQL,
    "op9_warc": OP9_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
