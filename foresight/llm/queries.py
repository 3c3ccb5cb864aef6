"""All queries of this subpackage: importing it fills the registry."""

from foresight.llm import (  # noqa: F401
    q_bpe,
    q_langid,
    q_merkle,
    q_mixing,
    q_pii,
    q_repeats,
    q_secrets,
    q_simhash,
    q_toxicity,
    q_trie,
    q_vectors,
)
from foresight.llm.registry import QUERIES, SQL  # noqa: F401
