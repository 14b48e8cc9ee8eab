"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it. Every operator takes DataFrames
with any extra columns, reads only the columns it names, and keeps one result
row per input row unless its docstring says otherwise.
"""
