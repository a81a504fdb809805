"""Registered queries, by family."""

from panelkit.plans import aggregates, columns, estimates, invariants, joining, latents, relations, scans, spells, temporal, texts  # noqa: F401
