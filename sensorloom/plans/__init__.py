"""Registered queries: importing the package registers all of them."""

from . import queries, advanced, groups, pulses  # noqa: F401
