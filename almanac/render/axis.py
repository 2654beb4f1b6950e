"""Axis domains and labels for small results on the driver."""

from __future__ import annotations

from decimal import Decimal


def axis_domain(values: list[float], ticks: int = 5) -> tuple[float, float, list[str]]:
    """Bounds with eight per cent of room (one per cent about a constant), and evenly spaced labels that differ."""
    low, high = min(values), max(values)
    room = (abs(low) or 1.0) * (0.01 if low else 1.0) if low == high else (high - low) * 0.08
    low, high = low - room, high + room
    step = (Decimal(high) - Decimal(low)) / (ticks - 1)
    places = [Decimal(low) + step * k for k in range(ticks)]
    for digits in range(5, 21):
        labels = [f"{p:.{digits}g}" for p in places]
        if len(set(labels)) == ticks:
            break
    return low, high, labels
