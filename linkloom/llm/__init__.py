"""Training-data operators (one module each) and their registered queries.

Nothing else in the library imports this subpackage.
"""
