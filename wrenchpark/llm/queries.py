"""The ``opN_*`` queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_token_alignment
from .bpe import op3_transducer_bpe
from .fertility import op11_tokeniser_fertility
from .knn import op8_voronoi_knn
from .licenses import op4_rare_token_licenses
from .near import op6_chosen_path
from .packing import op2_bm25_packing
from .quality import op10_quality
from .ranking import ORACLE as RANKING_SQL
from .ranking import op13_aho_corasick_ranking
from .rangejoin import op7_metric_range_join
from .repeats import op1_lyndon_suffixes
from .secrets import op9_markov_secrets
from .shards import op5_minimax_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lyndon_suffixes": op1_lyndon_suffixes,
    "op2_bm25_packing": op2_bm25_packing,
    "op3_transducer_bpe": op3_transducer_bpe,
    "op4_rare_token_licenses": op4_rare_token_licenses,
    "op5_minimax_shards": op5_minimax_shards,
    "op6_chosen_path": op6_chosen_path,
    "op7_metric_range_join": op7_metric_range_join,
    "op8_voronoi_knn": op8_voronoi_knn,
    "op9_markov_secrets": op9_markov_secrets,
    "op10_quality": op10_quality,
    "op11_tokeniser_fertility": op11_tokeniser_fertility,
    "op12_token_alignment": op12_token_alignment,
    "op13_aho_corasick_ranking": op13_aho_corasick_ranking,
}

ORACLE: dict[str, str] = {"op13_aho_corasick_ranking": RANKING_SQL}
