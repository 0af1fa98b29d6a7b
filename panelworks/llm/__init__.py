"""Operators for preparing training text at scale.

Every operator is a ``DataFrame -> DataFrame`` function with its own interface; the
``opN_*`` queries in :mod:`panelworks.llm.queries` derive digest columns from them.
Nothing outside this subpackage imports it.
"""
