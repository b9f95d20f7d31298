from seqloom.sources.readers import read_interactions, read_item_catalog, read_item_info
from seqloom.sources.writers import (
    append_run_metrics,
    write_interactions,
    write_item_info,
    write_pairs,
    write_relevance_jsonl,
    write_shards,
)

__all__ = [
    "append_run_metrics",
    "read_interactions",
    "read_item_catalog",
    "read_item_info",
    "write_interactions",
    "write_item_info",
    "write_pairs",
    "write_relevance_jsonl",
    "write_shards",
]
