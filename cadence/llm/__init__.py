"""Operators for corpus preparation; see ``cadence/llm/queries.py`` for the registered queries."""
