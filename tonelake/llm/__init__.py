"""Operators for large-scale training-data pipelines.

Nothing else in ``tonelake`` imports this subpackage; its queries and oracle
SQL live in :mod:`tonelake.llm.queries`.
"""
