"""Loads every query module; the registry holds the result."""

from retrials.plans import q_arms, q_attempts, q_design, q_metrics, q_models, q_predictions, q_probes, q_text, q_tokens  # noqa: F401
from retrials.plans.registry import ORACLES, QUERIES  # noqa: F401
