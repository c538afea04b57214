"""Operators of a training-data pipeline: cleaning, scanning, joining, searching and packing text.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; :mod:`newsloom.llm.queries` holds the thin queries
that apply them to the whole tables.
"""
