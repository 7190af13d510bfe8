"""Training-data operators: quality, deduplication, mixing, sharding, archives.

Nothing else in the library imports this subpackage.
"""

from granary.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
