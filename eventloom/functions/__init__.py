"""Scalar functions of the event language, as columns."""
