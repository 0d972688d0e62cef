"""Operators for preparing training corpora. Nothing else in ``nearword`` imports this subpackage."""
