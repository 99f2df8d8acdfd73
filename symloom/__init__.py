"""Symloom: a Spark-first analytics engine for source corpora.

Everything relational is a DataFrame plan for Catalyst; Python code is limited
to language-aware lexing, which runs in Arrow batches.
"""

__version__ = "0.1.0"
