"""The kinds of signals that questions ask about, and which operators find them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Signal:
    ops: tuple[str, ...]  # operators that answer questions about it
    tolerance: int | None = None  # days between the claimed and a found date


# Names in registry order and tolerances.
SIGNALS: dict[str, Signal] = {
    "trend_up": Signal(("trend", "growth")),
    "trend_down": Signal(("trend", "growth")),
    "anomaly_spike": Signal(("anomaly_auto", "anomaly_zscore"), tolerance=7),
    "anomaly_drop": Signal(("anomaly_auto", "anomaly_zscore"), tolerance=7),
    "anomaly_contextual": Signal(("anomaly_contextual",), tolerance=1),
    "segment_drag": Signal(("segments",)),
    "scope_refusal": Signal(("refusal",)),
    "forecast_up": Signal(("forecast",)),
    "cohort_question": Signal(("cohort",)),
}
ADDED_LATER = ("forecast_up", "cohort_question")
# The growth rate that counts as a trend, and the one that strict verification asks for.
GROWTH, STRICT_GROWTH = 0.02, 0.03


def signal_types(types: list[str] | None = None, delta_from: str | None = None) -> list[str]:
    """Chosen types, checked; with `delta_from` only those added after it."""
    chosen = list(SIGNALS) if types is None else list(types)
    for t in chosen:
        if t not in SIGNALS:
            raise ValueError(f"Unknown signal_type: {t!r}. Valid: {list(SIGNALS)}")
    return [t for t in chosen if delta_from is None or t in ADDED_LATER]
