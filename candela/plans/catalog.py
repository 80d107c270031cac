"""Importing this module registers every query."""

from candela.plans import evaluation, market, news, records, trading  # noqa: F401
