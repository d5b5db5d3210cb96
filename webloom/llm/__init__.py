"""Operators for preparing training data at scale.

Nothing else in ``webloom`` imports this subpackage. The driver queries are in
``webloom.llm.queries``.
"""
