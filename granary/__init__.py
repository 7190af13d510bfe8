"""Granary: corpus indexing, retrieval and question routing as PySpark jobs.

Every operator takes DataFrames and returns DataFrames; configuration
(word lists, registries, rules, package names) is passed as arguments.
"""

__version__ = "0.1.0"
