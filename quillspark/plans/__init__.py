"""All registered queries of the core."""

from __future__ import annotations


def registries():
    """The core's registries, imported when asked for."""
    from . import evaluation, ledger, messages, retrieval

    return [messages.registry, ledger.registry, retrieval.registry, evaluation.registry]
