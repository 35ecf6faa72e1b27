"""Queries over the driver's tables; those of ``stored`` are registered in ``queries``."""

from celestile.plans import queries, stored  # noqa: F401
