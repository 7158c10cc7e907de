"""A client of made-up pages for the paged source."""

from __future__ import annotations


class Pages:
    def __init__(self, options):
        self.options = options

    def page(self, channel, cursor, since):
        """Five items a page, a day apart, newest first; page three is the last."""
        n = cursor or 0
        days = range(30 - 5 * n, 25 - 5 * n, -1)
        items = [{"id": f"{channel}:{d}", "date": f"2024-01-{d:02d}T00:00:00Z", "text": "t"} for d in days]
        return items + items[:1], n + 1 if n < 2 else None
