"""All queries of the corpus operators."""

from pluvia.llm import (  # noqa: F401
    bpe,
    decontaminate,
    hmm,
    language_id,
    lloyd,
    mixing,
    quality,
    resample,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
    url_filter,
)
from pluvia.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
