"""Importing this module registers the queries of the subpackage."""

from tidemark.llm import (  # noqa: F401
    decontamination, language, licenses, merkle, quality, secrets, sentencepieces, simhash, tokencounts, toxicity, urls, variants, vectors)
from tidemark.llm.registry import QUERIES, SQL  # noqa: F401
