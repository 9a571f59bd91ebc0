"""Registered queries of the training-data operators; SQL holds DuckDB's form where there is one."""

from __future__ import annotations

from spanloom.llm import mixing, prefix_trie, spelling
from spanloom.llm.bpe import op6_bpe
from spanloom.llm.licenses import op9_license_scan
from spanloom.llm.nearest import op5_nearest
from spanloom.llm.neardup import op1_ngram_jaccard_join
from spanloom.llm.packing import op13_packing
from spanloom.llm.quality_model import op3_quality_classifier
from spanloom.llm.quality_rules import op4_quality_rules
from spanloom.llm.secrets import op2_secret_scan
from spanloom.llm.sharding import op8_sharding
from spanloom.llm.token_edits import op10_token_edits

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_nearest": op5_nearest,
    "op6_bpe": op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_license_scan": op9_license_scan,
    "op10_token_edits": op10_token_edits,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_packing": op13_packing,
}
SQL = {"op7_mixing": mixing.OP7_SQL, "op11_spelling_variants": spelling.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
