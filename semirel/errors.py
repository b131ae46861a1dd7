"""Errors of the algebra."""


class AlgebraError(ValueError):
    """An expression that has no meaning as a relation, such as the sum over all of a function."""
