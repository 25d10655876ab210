"""Training-data operators: thirteen large-scale operators and the tables they share.

Nothing else in the library imports this subpackage.
"""
