"""Imports every query module so that ``REGISTRY`` is complete."""

from __future__ import annotations

from bookrisk.plans import q_core, q_drift, q_metrics, q_reports, q_stores, q_stream, q_train  # noqa: F401
from bookrisk.plans.catalog import REGISTRY

__all__ = ["REGISTRY"]
