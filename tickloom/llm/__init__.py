"""Operators for large text corpora: scoring, extraction, tokens, near copies, archives, packing.

Nothing else in the library imports this package. Every operator takes DataFrames and column
names, reads only the columns it names (others may be there under any name), treats NULL text as
empty text, and says in its docstring what it returns for the odd cases.
"""
