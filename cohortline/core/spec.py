"""Parameters of a cohort study."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# The study settings used when nothing else is given.
TARGET_CODE_PATTERN = "296.2|296.3"
INDEX_PHASES = ("admission", "intermediate")
FIRST_YEAR = 2008
AS_OF = dt.date(2020, 10, 12)
FOLLOW_UP_DAYS = 5 * 365
LOOK_BACK_DAYS = 2 * 365
MIN_DAYS = 5
MIN_EVENTS = 5
MIN_MINUTES = 60


@dataclass(frozen=True)
class CohortSpec:
    """Who enters the cohort and which days around the index date are read.

    ``code_pattern`` is an unanchored regular expression, so a dot matches any
    character. Windows are closed intervals in days relative to the index date:
    prior care is everything before day 0, follow-up is day 0 to
    ``follow_up_days``, the month table covers ``-look_back_days`` to
    ``follow_up_days``.
    """

    code_pattern: str = TARGET_CODE_PATTERN
    phases: tuple[str, ...] = INDEX_PHASES
    first_year: int = FIRST_YEAR
    as_of: dt.date = AS_OF
    follow_up_days: int = FOLLOW_UP_DAYS
    look_back_days: int = LOOK_BACK_DAYS
    min_days: int = MIN_DAYS
    min_events: int = MIN_EVENTS
    min_minutes: float = MIN_MINUTES
    tie_break: tuple[str, ...] = ()
