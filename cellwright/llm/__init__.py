"""Training-data operators.  Nothing outside this package imports it.

Each module holds one operator with a general interface; ``queries`` binds them to the
tables of the test data and derives the digest columns from the operators' real output.
"""
