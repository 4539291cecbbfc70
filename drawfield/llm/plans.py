"""The queries of this subpackage, each with its SQL where SQL can state the result."""

from drawfield.llm import (  # noqa: F401
    circulant, decontaminate, huffman, jaccard, packing, pairscore, search, sharding, toolcalls, toxicity, urls, vectorcodes, warc)
from drawfield.llm.common import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
