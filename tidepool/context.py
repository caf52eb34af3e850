"""The clock and constants that every review operator is given; nothing here asks the system for the time."""

from __future__ import annotations

from dataclasses import dataclass

DAY = 86_400


@dataclass(frozen=True)
class Clock:
    """Times in seconds. next_day_at is the next rollover; days_elapsed counts rollovers since the tables began."""

    now: int
    next_day_at: int
    days_elapsed: int
    utc_offset: int = 0

    @property
    def day_start(self) -> int:
        return self.next_day_at - DAY


#: The clock of the fixture tables: 2024-01-31 00:00 UTC, rollover at four.
FIXED = Clock(now=1_706_659_200, next_day_at=1_706_673_600, days_elapsed=29)

# Card types, queues and review kinds, as the tables store them.
NEW, LEARN, REVIEW, RELEARN = 0, 1, 2, 3
USER_BURIED, SIBLING_BURIED, SUSPENDED = -3, -2, -1
KIND_LEARN, KIND_REVIEW, KIND_RELEARN, KIND_FILTERED, KIND_MANUAL, KIND_RESCHEDULED = range(6)
MATURE_DAYS = 21
