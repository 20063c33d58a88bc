"""Bulk tabular intake on Spark: decode, gate, chunk, validate, assemble, report."""
