"""Training-data operators: one module per operator, plus the queries that apply them.

Nothing outside this folder imports it; it can be removed as a whole.
"""
