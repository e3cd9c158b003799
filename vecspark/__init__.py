"""Ordered-vector and sparse-matrix analytics on Spark DataFrames.

Vectors are (idx, val), matrices (row, col, val). Operators are in vecspark.operators, readers in vecspark.sources.
"""

from vecspark.operators import compact, element, gather, linalg, order, reduce, sampling, scan, segment, sparse
from vecspark.sources import matrices, vectors

__all__ = ["compact", "element", "gather", "linalg", "matrices", "order", "reduce", "sampling", "scan", "segment", "sparse", "vectors"]
