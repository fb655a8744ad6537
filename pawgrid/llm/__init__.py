"""Training-data pipeline operators: each module holds one operator and its ``opN`` query.

Nothing else in the package imports this subpackage.
"""
