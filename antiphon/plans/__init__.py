"""Queries over the driver's tables, by what they are about."""

from __future__ import annotations

from antiphon.plans import audits, chats, corpus, journals, matching, prompts, selection, tensors
from antiphon.plans.registry import ORACLE, QUERIES, Query

__all__ = ["ORACLE", "QUERIES", "Query", "audits", "chats", "corpus", "journals", "matching", "prompts", "selection", "tensors"]
