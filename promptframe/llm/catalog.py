"""All queries of this subpackage."""

from promptframe.llm import (  # noqa: F401
    bpe,
    hamming,
    jaccard,
    language,
    licenses,
    packing,
    pages,
    quality,
    secrets,
    sharding,
    toolcalls,
    variants,
    whitening,
)
from promptframe.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
