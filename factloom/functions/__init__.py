"""Scalar functions, list primitives and the sentence parser."""
