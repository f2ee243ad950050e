"""Phrases of time as half-open UTC windows.

A text is read word by word. A *day* (a date, a named day, a weekday, a distance in days) may be followed by a *clock*
time, a range of them, or a part of the day; a *span* is a side (past, this, coming) with a unit, or a number of units,
or a month, quarter or year by name. At each word the longest reading wins, and reading goes on behind it.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

MONTHS = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if name} | {"sept": 9}
WEEKDAYS = {name.lower(): i for names in (calendar.day_name, calendar.day_abbr) for i, name in enumerate(names)} | {"tues": 1, "thurs": 3}
PAST, THIS, COMING = ("last", "previous", "past", "prior"), ("this", "current"), ("next", "coming", "upcoming", "following")
SIDES = {w: s for s, words in ((-1, PAST), (0, THIS), (1, COMING)) for w in words}
NUMBERS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())} | {"a": 1, "an": 1, "couple": 2, "few": 3}
PARTS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 23), "night": (18, 24)}
SECONDS = {"minute": 60, "min": 60, "hour": 3600, "hr": 3600}
DAYS = {"day": 1, "week": 7, "fortnight": 14}
CALENDAR = {"month": 1, "quarter": 3, "year": 12}
NAMED_DAYS = {("today",): 0, ("tomorrow",): 1, ("yesterday",): -1, ("day", "after", "tomorrow"): 2, ("day", "before", "yesterday"): -2}
#: A day without a year belongs to the next year when it is longer past than this.
ROLL_OVER = timedelta(days=180)
_WORD = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}:\d\d|\d+|[a-z]+", re.I)
_ORDINAL = ("st", "nd", "rd", "th")


@dataclass(frozen=True)
class Window:
    start: datetime
    end: datetime
    rule: str
    text: str


@dataclass(frozen=True)
class Clock:
    """Now, in a zone, with the week's first day (0 is Monday)."""

    now: datetime
    zone: str = "UTC"
    week_start: int = 0

    @property
    def today(self) -> date:
        return self.now.astimezone(ZoneInfo(self.zone)).date()

    def at(self, day: date, minutes: int = 0) -> datetime:
        """A local wall time in UTC; a time that the clocks skip is taken with the offset before the change."""
        wall = datetime.combine(day, time()) + timedelta(minutes=minutes)
        return wall.replace(tzinfo=ZoneInfo(self.zone)).astimezone(UTC)

    def days(self, first: date, n: int = 1) -> tuple[datetime, datetime]:
        return self.at(first), self.at(first + timedelta(days=n))

    def months(self, first: int, n: int) -> tuple[datetime, datetime]:
        """From month number ``first`` (12 * year + month - 1) on."""
        return tuple(self.at(date(k // 12, k % 12 + 1, 1)) for k in (first, first + n))


class _Reader:
    def __init__(self, text: str, clock: Clock) -> None:
        found = list(_WORD.finditer(text))
        self.words = [m[0].lower() for m in found]
        self.places = [m.span() for m in found]
        self.clock, self.today = clock, clock.today

    def word(self, i: int) -> str:
        return self.words[i] if i < len(self.words) else ""

    def after(self, i: int, *optional: str) -> int:
        """The place behind words that may stand there."""
        while self.word(i) in optional:
            i += 1
        return i

    def number(self, i: int) -> tuple[int, int] | None:
        w = self.word(i)
        if w in ("a", "an") and self.word(i + 1) in ("couple", "few"):
            i, w = i + 1, self.word(i + 1)
        n = int(w) if w.isdigit() and len(w) < 4 else NUMBERS.get(w)
        return None if n is None else (n, self.after(i + 1, "of") if w in ("couple", "few") else i + 1)

    def unit(self, i: int) -> str | None:
        w = self.word(i)
        return next((u for u in (w, w.removesuffix("s")) if u in SECONDS or u in DAYS or u in CALENDAR), None)

    # -- days -------------------------------------------------------------------------------------------------

    def day(self, i: int) -> tuple[date, int] | None:
        return max((x for x in (self.iso(i), self.date(i), self.named(i), self.weekday(i), self.distant(i)) if x), key=lambda x: x[1], default=None)

    def iso(self, i: int) -> tuple[date, int] | None:
        try:
            return date.fromisoformat(self.word(i)), i + 1
        except ValueError:
            return None

    def date(self, i: int) -> tuple[date, int] | None:
        """Month and day of the month in either order, with or without a year."""
        i = self.after(i, "on", "the")
        for day_first in (True, False):
            j, number, month = i, None, None
            for want_number in (day_first, not day_first):
                j = self.after(j, "of", "the")
                w = self.word(j)
                if want_number and w.isdigit() and len(w) < 3:
                    number, j = int(w), self.after(j + 1, *_ORDINAL)
                elif not want_number and w in MONTHS:
                    month, j = MONTHS[w], j + 1
            if number is None or month is None:
                continue
            year = self.word(j)
            given = len(year) == 4 and year.isdigit()
            try:
                d = date(int(year) if given else self.today.year, month, number)
                if not given and self.today - d > ROLL_OVER:
                    d = d.replace(year=d.year + 1)
            except ValueError:
                return None
            return d, j + given
        return None

    def named(self, i: int) -> tuple[date, int] | None:
        i = self.after(i, "the")
        for words, n in NAMED_DAYS.items():
            if tuple(self.words[i : i + len(words)]) == words:
                return self.today + timedelta(days=n), i + len(words)
        return None

    def weekday(self, i: int) -> tuple[date, int] | None:
        """With a side that of the week before, this or after (weeks begin on Monday), alone the coming one, today's included."""
        i = self.after(i, "on")
        side = SIDES.get(self.word(i))
        n = WEEKDAYS.get(self.word(i + (side is not None)))
        if n is None:
            return None
        if side is None:
            return self.today + timedelta(days=(n - self.today.weekday()) % 7), i + 1
        return self.today + timedelta(days=n - self.today.weekday() + 7 * side), i + 2

    def distant(self, i: int) -> tuple[date, int] | None:
        """So many days or weeks ago, from now, or in so many."""
        ahead = self.word(i) == "in"
        if not (n := self.number(i + ahead)) or (unit := self.unit(n[1])) not in DAYS:
            return None
        j, days = n[1] + 1, n[0] * DAYS[unit]
        if ahead:
            return self.today + timedelta(days=days), j
        if self.word(j) == "ago":
            return self.today - timedelta(days=days), j + 1
        return (self.today + timedelta(days=days), j + 2) if self.words[j : j + 2] == ["from", "now"] else None

    # -- times of a day ---------------------------------------------------------------------------------------

    def clock_time(self, i: int) -> tuple[int, int, bool] | None:
        """Minutes of the day, the place behind, and whether it needs no "at" to be a time."""
        w = self.word(i)
        if w in ("noon", "midday", "midnight"):
            return (0 if w == "midnight" else 720), i + 1, True
        hour, _, minute = w.partition(":")
        if not hour.isdigit() or len(hour) > 2:
            return None
        half = self.word(i + 1)
        if half in ("am", "pm"):
            return (int(hour) % 12 + 12 * (half == "pm")) * 60 + int(minute or 0), i + 2, True
        return (int(hour) * 60 + int(minute or 0), i + 1, bool(minute)) if int(hour) < 24 else None

    def hours(self, i: int) -> tuple[int, int, int] | None:
        """From and until in minutes of the day, and the place behind: a time (an hour long), a range, or a part."""
        j = self.after(i, "in", "the")
        if self.word(j) in PARTS and (j > i or i):
            a, b = PARTS[self.word(j)]
            return a * 60, b * 60, j + 1
        lead = self.word(i)
        first = self.clock_time(i + (lead in ("at", "from", "between")))
        if not first:
            return None
        if self.word(first[1]) in ("to", "until", "and") and lead != "at" and (last := self.clock_time(first[1] + 1)):
            a, b = first[0], last[0]
            if a < 720 <= b and a + 720 < b and not first[2]:
                a += 720  # from 2 to 4 pm
            if a < b and (lead in ("from", "between") or first[2] or last[2]):
                return a, b, last[1]
        return (first[0], first[0] + 60, first[1]) if lead == "at" or (first[2] and lead not in ("from", "between")) else None

    # -- spans ------------------------------------------------------------------------------------------------

    def span(self, i: int) -> tuple[tuple[datetime, datetime], int] | None:
        return max((x for x in (self.sided(i), self.rolling(i), self.period(i)) if x), key=lambda x: x[1], default=None)

    def sided(self, i: int) -> tuple[tuple[datetime, datetime], int] | None:
        """A side and a unit of the calendar, or the weekend."""
        i = self.after(i, "the")
        side, what, c = SIDES.get(self.word(i)), self.word(i + 1), self.clock
        if side is None:
            return None
        if what == "weekend":
            return c.days(self.today + timedelta(days=5 - self.today.weekday() + 7 * side), 2), i + 2
        if what == "week":
            return c.days(self.today - timedelta(days=(self.today.weekday() - c.week_start) % 7 - 7 * side), 7), i + 2
        if (n := CALENDAR.get(what)) is None:
            return None
        here = self.today.year * 12 + self.today.month - 1
        return c.months(here - here % n + side * n, n), i + 2

    def rolling(self, i: int) -> tuple[tuple[datetime, datetime], int] | None:
        """So many units back from now or on from now; hours and minutes ago, or in so many, are one unit long."""
        i, now = self.after(i, "the"), self.clock.now
        side = SIDES.get(self.word(i)) or (1 if self.word(i) == "within" else 0)
        ahead = not side and self.word(i) == "in"
        if not (n := self.number(i + bool(side or ahead))) or not (unit := self.unit(n[1])):
            return None
        j = n[1] + 1
        if unit in CALENDAR:
            return None if not side else (((self.moved(side * n[0] * CALENDAR[unit]), now) if side < 0 else (now, self.moved(n[0] * CALENDAR[unit]))), j)
        step = timedelta(seconds=SECONDS[unit]) if unit in SECONDS else timedelta(days=DAYS[unit])
        if side:
            return ((now - n[0] * step, now) if side < 0 else (now, now + n[0] * step)), j
        if unit in SECONDS and (ahead or self.words[j : j + 2] == ["from", "now"]):
            return (now + n[0] * step, now + (n[0] + 1) * step), j + 2 * (not ahead)
        if unit in SECONDS and self.word(j) == "ago":
            return (now - n[0] * step, now - (n[0] - 1) * step), j + 1
        return None

    def moved(self, months: int) -> datetime:
        """Now, so many months later, on the last day of a shorter month if need be."""
        local = self.clock.now.astimezone(ZoneInfo(self.clock.zone))
        k = local.year * 12 + local.month - 1 + months
        day = min(local.day, calendar.monthrange(k // 12, k % 12 + 1)[1])
        return local.replace(year=k // 12, month=k % 12 + 1, day=day).astimezone(UTC)

    def period(self, i: int) -> tuple[tuple[datetime, datetime], int] | None:
        """A month with its year, a quarter (q3 2024), a month or a year behind "in"."""
        lead = self.word(i) in ("in", "during")
        i += lead
        w, year = self.word(i), self.word(i + 1)
        known = len(year) == 4 and year.isdigit()
        if w in MONTHS and (known or lead):
            here = self.today
            y = int(year) if known else here.year + (here.month - MONTHS[w] > 6)
            return self.clock.months(y * 12 + MONTHS[w] - 1, 1), i + 1 + known
        if w == "q" and year.isdigit() and 1 <= int(year) <= 4:
            behind = self.word(i + 2)
            given = len(behind) == 4 and behind.isdigit()
            return self.clock.months((int(behind) if given else self.today.year) * 12 + 3 * int(year) - 3, 3), i + 2 + given
        return (self.clock.months(int(w) * 12, 12), i + 1) if lead and len(w) == 4 and w.isdigit() else None

    # -- all together -----------------------------------------------------------------------------------------

    def read(self, i: int) -> tuple[tuple[datetime, datetime], int, str] | None:
        found = []
        if d := self.day(i):
            h = self.hours(d[1]) or (self.hours(d[1] + 1) if self.word(d[1]) in ("around", "about") else None)
            found.append(((self.clock.at(d[0], h[0]), self.clock.at(d[0], h[1])), h[2], "day_time") if h else (self.clock.days(d[0]), d[1], "day"))
        if s := self.span(i):
            found.append((*s, "span"))
        if self.word(i) == "tonight" or (self.word(i) in THIS and self.word(i + 1) in PARTS):
            a, b = PARTS["night" if self.word(i) == "tonight" else self.word(i + 1)]
            found.append(((self.clock.at(self.today, a * 60), self.clock.at(self.today, b * 60)), i + 1 + (self.word(i) != "tonight"), "part"))
        elif (h := self.hours(i)) and self.word(i) not in ("in", "the") and self.word(i) not in PARTS:
            found.append(((self.clock.at(self.today, h[0]), self.clock.at(self.today, h[1])), h[2], "clock"))
        return max(found, key=lambda x: x[1], default=None)


def scan(text: str, clock: Clock) -> list[Window]:
    """All windows of a text, in its order."""
    reader, out, i = _Reader(text, clock), [], 0
    while i < len(reader.words):
        if found := reader.read(i):
            (start, end), j, kind = found
            out.append(Window(start.astimezone(UTC), end.astimezone(UTC), kind, text[reader.places[i][0] : reader.places[j - 1][1]]))
            i = j
        else:
            i += 1
    return out


def resolve(text: str, clock: Clock) -> Window | None:
    found = scan(text, clock)
    return found[0] if found else None


def target_slot(text: str, clock: Clock, minutes: int = 30) -> tuple[datetime, datetime] | None:
    """When something is to happen: a named time for as long as asked, else from the beginning of the window."""
    w = resolve(text, clock)
    if w is None:
        return None
    return (w.start, w.end) if w.rule in ("day_time", "clock") and w.end - w.start != timedelta(hours=1) else (w.start, w.start + timedelta(minutes=minutes))
