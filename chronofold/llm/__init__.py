"""Training-data operators: ten distributed corpus operations over ``documents``-shaped tables.

Nothing else in the library imports this subpackage.
"""
