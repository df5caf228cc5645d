"""Queries and SQL of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from panolake.llm.alignment import op12_alignment
from panolake.llm.ann import op1_nearest
from panolake.llm.bpe import op3_bpe
from panolake.llm.fingerprints import OP10_SQL, op10_fingerprints
from panolake.llm.license_scan import op6_license_scan
from panolake.llm.lines import OP8_SQL, op8_line_dedup
from panolake.llm.packing import op9_packing
from panolake.llm.pq_dedup import OP11_SQL, op11_pq_dedup
from panolake.llm.simhash import op4_simhash
from panolake.llm.sort_means import OP13_SQL, op13_sort_means
from panolake.llm.substring import op7_substring_dedup
from panolake.llm.token_store import op5_token_store
from panolake.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_simhash": op4_simhash,
    "op5_token_store": op5_token_store,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_fingerprints": op10_fingerprints,
    "op11_pq_dedup": op11_pq_dedup,
    "op12_alignment": op12_alignment,
    "op13_sort_means": op13_sort_means,
}

#: DuckDB SQL where SQL can express a query.
ORACLE: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op10_fingerprints": OP10_SQL, "op11_pq_dedup": OP11_SQL, "op13_sort_means": OP13_SQL}
