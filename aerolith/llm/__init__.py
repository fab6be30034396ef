"""Training-data operators: ten independent Spark jobs over text and page tables.

Nothing outside this folder imports it; `queries.py` registers its queries.
"""
