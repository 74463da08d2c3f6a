"""Grouping large text corpora with Spark: vectorise, reduce, cluster, score, compare.

Every operator takes and returns DataFrames keyed by an explicit row ``id``; what reaches
the driver is bounded by a parameter (centres, a sketch, metric rows), never by the rows.
"""

__version__ = "0.1.0"
