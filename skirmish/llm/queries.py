"""The corpus queries and their DuckDB SQL (where SQL expresses them)."""

from __future__ import annotations

import corpus_pipeline

from skirmish.llm import embedding_dedup, line_dedup, prefix_trie, substring_dedup, url_filter
from skirmish.llm.decontaminate import op1_decontaminate
from skirmish.llm.embedding_dedup import op5_embedding_dedup
from skirmish.llm.jaccard_join import op8_jaccard_join
from skirmish.llm.license_scan import op10_license_scan
from skirmish.llm.line_dedup import op11_line_dedup
from skirmish.llm.packing import op4_packing
from skirmish.llm.pii import op3_pii
from skirmish.llm.prefix_trie import op13_prefix_trie
from skirmish.llm.quality import op9_quality
from skirmish.llm.structure_repair import op12_structure_repair
from skirmish.llm.substring_dedup import op7_substring_dedup
from skirmish.llm.suffix_dedup import op2_suffix_dedup
from skirmish.llm.url_filter import op6_url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_decontaminate": op1_decontaminate,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_line_dedup": op11_line_dedup,
    "op12_structure_repair": op12_structure_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {"op5_embedding_dedup": embedding_dedup.ORACLE_SQL, "op6_url_filter": url_filter.ORACLE_SQL,
          "op7_substring_dedup": substring_dedup.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL,
          "op13_prefix_trie": prefix_trie.ORACLE_SQL}
