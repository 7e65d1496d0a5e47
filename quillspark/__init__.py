"""quillspark: analytics on ordinary Spark DataFrames.

The subpackages hold relational, key-value, stream, text-search, graph and
vector operators.  Everything returns lazy DataFrames unless its docstring says
otherwise.
"""
