"""Queries over the driver's tables, each with its SQL; all register in ``queries``."""

from . import changes, library, moves, pages, payloads, queries, scans, sidecars, streams  # noqa: F401
