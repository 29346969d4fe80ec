"""Training-data operators: ten self-contained corpus operations.

Nothing else in the package imports this subpackage.  ``queries`` holds the registered
queries and their SQL; every other module is one operator.
"""
