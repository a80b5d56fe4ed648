"""Metrics: registry of names."""

from __future__ import annotations

from collections.abc import Iterable

from glossmark.operators.metrics.base import Metric
from glossmark.operators.metrics.bleu import Bleu
from glossmark.operators.metrics.length import Length
from glossmark.operators.metrics.meteor import Meteor
from glossmark.operators.metrics.ter import Ter

REGISTRY: dict[str, type[Metric]] = {"bleu": Bleu, "length": Length, "ter": Ter, "meteor": Meteor}


def register(name: str, metric: type[Metric]) -> None:
    """Add a metric of one's own; see Metric for what it must define."""
    REGISTRY[name.lower()] = metric


def load(names: str | Iterable[str | Metric], **options: dict) -> list[Metric]:
    """Metrics by name, case ignored; ``options`` holds the arguments of each by its name."""
    out = []
    for n in names.split() if isinstance(names, str) else names:
        if isinstance(n, Metric):
            out.append(n)
        elif n.lower() not in REGISTRY:
            raise ValueError(f"unknown metric {n!r}; there are {', '.join(sorted(REGISTRY))}")
        else:
            out.append(REGISTRY[n.lower()](**options.get(n.lower(), {})))
    return out
