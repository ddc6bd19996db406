"""Operators for preparing training data (text, vectors, archives).

Nothing else in the library imports this subpackage. ``catalog`` lists the
registered queries; each operator module holds one operator with its own
general interface and the thin query of its contract.
"""
