"""Operators for preparing large-scale training text.

Nothing outside this package imports it; ``queries`` and ``oracle_sql`` of
:mod:`granthika.llm.registry` are added to the driver entry when it is present.
"""
