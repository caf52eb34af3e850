"""The memory model for one card at a time, as the stateful stream needs it; operators.memory has it as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from tidepool.operators.memory import D_MAX, D_MIN, S_MAX, S_MIN


def _within(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def first(w: Sequence[float], rating: float) -> tuple[float, float]:
    return _within(w[int(rating) - 1], S_MIN, S_MAX), _within(w[4] - math.exp(w[5] * (rating - 1)) + 1, D_MIN, D_MAX)


def step(w: Sequence[float], days: float, rating: float, s: float, d: float) -> tuple[float, float]:
    s, d = _within(s, S_MIN, S_MAX), _within(d, D_MIN, D_MAX)
    if days == 0:
        growth = math.exp(w[17] * (rating - 3 + w[18])) * s ** -w[19]
        new = s * (max(growth, 1.0) if rating >= 2 else growth)
    else:
        r = (days / s * (math.exp(math.log(0.9) / -w[20]) - 1) + 1) ** -w[20]
        if rating == 1:
            new = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp((1 - r) * w[14]), s / math.exp(w[17] * w[18]))
        else:
            bonus = {2.0: w[15], 4.0: w[16]}.get(rating, 1.0)
            new = s * (math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp((1 - r) * w[10]) - 1) * bonus + 1)
    moved = d - w[6] * (rating - 3) * (10 - d) / 9
    easiest = w[4] - math.exp(w[5] * 3) + 1
    return _within(new, S_MIN, S_MAX), _within(w[7] * (easiest - moved) + moved, D_MIN, D_MAX)
