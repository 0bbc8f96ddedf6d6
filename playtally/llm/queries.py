"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playtally.llm.decontaminate import op6_decontamination
from playtally.llm.divergence import ORACLE_SQL as DIVERGENCE_SQL
from playtally.llm.divergence import op11_divergence
from playtally.llm.editprint import op4_fingerprints
from playtally.llm.hash_tree import op13_shards
from playtally.llm.language import op10_language
from playtally.llm.license_scan import ORACLE_SQL as LICENSE_SQL
from playtally.llm.license_scan import op2_license_scan
from playtally.llm.lm_score import op9_lm_score
from playtally.llm.mask_search import ORACLE_SQL as SEARCH_SQL
from playtally.llm.mask_search import op12_search
from playtally.llm.phrase_dedup import op8_substring_dedup
from playtally.llm.pieces import op3_pieces
from playtally.llm.simhash import op5_simhash
from playtally.llm.suffix_dedup import op7_suffix_dedup
from playtally.llm.toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: tuple[Query, ...] = (
    op1_toxicity,
    op2_license_scan,
    op3_pieces,
    op4_fingerprints,
    op5_simhash,
    op6_decontamination,
    op7_suffix_dedup,
    op8_substring_dedup,
    op9_lm_score,
    op10_language,
    op11_divergence,
    op12_search,
    op13_shards,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Queries that DuckDB can answer as well; the others are tested by brute force."""
    return {"op2_license_scan": LICENSE_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_search": SEARCH_SQL}
