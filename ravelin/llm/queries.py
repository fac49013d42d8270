"""All queries of the package."""

from ravelin.llm import (  # noqa: F401
    decontaminate, extendible_shards, language_mixture, line_quality, merkle_manifest, minmax_dedup, piece_sampling, ranked_search, secrets,
    suffix_dedup, training_order, url_filter, warc,
)
from ravelin.llm.registry import CHECK_SQL, QUERIES  # noqa: F401
