"""All registered queries."""

from ledgerproof.plans import base, checking, detectors, gold, prompts, review, spans, text  # noqa: F401
from ledgerproof.plans.register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
