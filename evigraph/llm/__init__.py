"""Operators for preparing language-model training data.

Each module holds one operator with its own general interface; ``queries`` applies
them to the given tables and ``oracles`` states the same in SQL where SQL can.
"""
