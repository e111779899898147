"""Training-data operators: packing, media columns, filters, secrets, dedup.

Nothing outside this subpackage imports it.  Queries live in
:mod:`tidemark.llm.queries`, their SQL beside the operators.
"""
