"""Operators for preparing training corpora, their queries and the plain SQL they are checked against."""
