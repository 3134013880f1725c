"""All registered queries; importing the modules registers theirs."""

from textloom.plans import chains, corpus, evaluation, evidence, relations, renders, reports, rows, sources  # noqa: F401
from textloom.plans.registry import ORACLES, QUERIES  # noqa: F401
