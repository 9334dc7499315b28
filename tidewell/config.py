"""Values that operators take as parameters, with their defaults."""

from __future__ import annotations

import datetime

#: The day the fixture data is seen on. Operators never ask for the current date.
AS_OF = datetime.date(1998, 8, 2)

# Categories in canonical order, those switched on, and the canonical labels.
CATEGORIES = ["Grant", "RFP", "Tender", "Proposal", "Fellowship", "Award", "Challenge", "Other"]
ENABLED_CATEGORIES = ["Grant", "RFP", "Tender", "Proposal"]
#: Labels of the fixture data; a deployment passes its own.
VERTICALS = ["Health", "Education", "Climate", "Livelihood", "Gender", "Governance"]

SENTINELS = [datetime.date(9999, 12, 31), datetime.date(1, 1, 1), datetime.date(1970, 1, 1), datetime.date(1900, 1, 1)]
SENTINEL_DAYS = 3 * 365
REMINDER_DAYS = (10, 7, 2)
CAP_LADDER = (25, 15, 10, 6, 4, 2)
DIGEST_BUDGET = 95 * 1024
PAGE_SIZE, MAX_PAGE_SIZE = 25, 200
STALE_PAGES = 3
