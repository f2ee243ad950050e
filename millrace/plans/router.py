"""Whole messages of known shapes become plans without a model; anything else is left to the caller."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from ..functions.temporal import Clock, resolve
from .ir import Plan

_LEAD = re.compile(r"^(?:please|can you|could you|hey|hi|ok)[ ,]+", re.I)
_TIME = r"(?P<time>[\w :-]+?)"


def _window(text: str, clock: Clock) -> dict[str, int] | None:
    w = resolve(text, clock)
    if w is None or w.text.strip().lower() != text.strip().lower():
        return None
    return {"since": int(w.start.timestamp() * 1e6), "until": int(w.end.timestamp() * 1e6)}


def _read(op: str, args: Mapping[str, Any], style: str = "list") -> dict[str, Any]:
    return {"type": "plan", "answer_style": style, "intent": {"name": op, "services": [op.split(".")[0]], "has_write": False}, "steps": [{"id": "a", "op": op, "args": dict(args)}]}


def _timed(op: str, style: str = "list", **more: Any) -> Callable[[re.Match, Clock], dict[str, Any] | None]:
    def make(m: re.Match, clock: Clock) -> dict[str, Any] | None:
        w = _window(m["time"], clock)
        return None if w is None else _read(op, {**w, **more}, style)

    return make


def _recent(time: str | None, clock: Clock) -> dict[str, Any] | None:
    if time is None:
        return _read("drive.search", {"limit": 20})
    w = _window(time, clock)
    return None if w is None else _read("drive.search", {**w, "limit": 20})


#: In this order; a shape must take in the whole message.
SHAPES: list[tuple[str, re.Pattern, Callable[[re.Match, Clock], dict[str, Any] | None]]] = [
    ("calendar_count", re.compile(rf"how many (?:events|meetings) (?:do i have )?{_TIME}", re.I), _timed("calendar.search", "count", not_cancelled=True)),
    ("calendar_next", re.compile(r"(?:what(?:'s| is) )?my next (?:event|meeting)", re.I), lambda m, c: _read("calendar.search", {"since": int(c.now.timestamp() * 1e6), "not_cancelled": True, "limit": 1})),
    ("calendar_window", re.compile(rf"(?:what(?:'s| is)|show(?: me)?) (?:on )?my (?:calendar|events|meetings|agenda) (?:for |on )?{_TIME}", re.I), _timed("calendar.search", not_cancelled=True)),
    ("calendar_conflicts", re.compile(r"which (?P<a>\w+) events clash with (?P<b>\w+)", re.I), lambda m, c: _read("calendar.find_conflicts", {"title": m["a"].lower(), "against": m["b"].lower()})),
    ("email_from_address", re.compile(r"(?:e?mails?|messages) from (?P<who>[\w.+-]+@[\w.-]+)", re.I), lambda m, c: _read("mail.search", {"from_email": m["who"].lower()})),
    ("email_subject", re.compile(r"(?:e?mails?|messages) about (?P<what>[\w ]+)", re.I), lambda m, c: _read("mail.search", {"subject_contains": m["what"].strip()})),
    ("email_thread", re.compile(r"show thread (?P<id>\d+)", re.I), lambda m, c: _read("mail.search", {"thread_id": int(m["id"])})),
    ("drive_named", re.compile(r"(?:find|open) (?:the )?file (?:named |called )?(?P<name>[\w.-]+)", re.I), lambda m, c: _read("drive.search", {"name_contains": m["name"]})),
    ("drive_folder", re.compile(r"files in (?P<folder>/[\w/.-]+)", re.I), lambda m, c: _read("drive.search", {"folder_prefix": m["folder"]})),
    ("drive_recent", re.compile(r"(?:my )?(?:recent|latest|newest) files(?: (?:from |of )?(?P<time>[\w :-]+))?", re.I), lambda m, c: _recent(m["time"], c)),
    ("drive_largest", re.compile(r"(?:my )?(?:largest|biggest) files", re.I), lambda m, c: _read("drive.largest", {"limit": 20})),
]


def route(message: str, clock: Clock) -> tuple[str, Plan] | None:
    """The first shape that takes in the whole message, with its plan."""
    text = _LEAD.sub("", " ".join(message.split())).rstrip("?!. ")
    for name, pattern, make in SHAPES:
        if (m := pattern.fullmatch(text)) and (spec := make(m, clock)):
            return name, Plan.of(spec)
    return None
