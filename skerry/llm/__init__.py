"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; it stands alone beside
the relational engine and can be removed without touching it.
"""
