"""Operators for training-data pipelines; nothing else in orbweave imports this package.

Computed columns replace input columns of the same name; all other input columns pass through
where an operator returns its input rows.
"""
