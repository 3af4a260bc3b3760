"""Registered queries over the given tables, each with SQL where SQL can express it."""


def all_cases() -> dict:
    from . import analysis, modelling, preparation, shaping  # noqa: F401
    from .registry import CASES

    return CASES
