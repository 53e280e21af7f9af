"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; its queries are listed in
:mod:`seqweave.llm.queries`.
"""
