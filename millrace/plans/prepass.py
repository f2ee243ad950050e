"""What a message shows before any plan is made: hints, literals, and whether it asks about a structure."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.extract import literals
from ..functions.temporal import Clock, Window, scan
from ..operators.filters import kind_words

# Words that point back, that ask for a change, and that name labels.
DEIXIS = {"it", "that", "this", "them", "those", "these", "one", "he", "she", "they", "there"}
WRITES = {"send", "reply", "forward", "draft", "schedule", "book", "move", "cancel", "delete", "share", "rename", "create", "invite", "archive", "label"}
LABELS = {"unread": "UNREAD", "starred": "STARRED", "important": "IMPORTANT", "inbox": "INBOX", "sent": "SENT", "spam": "SPAM"}
POLITE = ("please", "can you", "could you", "would you", "hey", "hi", "hello", "ok", "okay", "i want you to", "i need you to")
#: Words of questions that filters alone can answer.
STRUCTURE = {"how", "many", "count", "list", "show", "all", "my", "the", "of", "in", "on", "for", "from", "to", "me", "do", "i", "have", "any", "next", "first", "last", "latest", "recent", "emails", "email", "mails", "messages", "events", "event", "meetings", "meeting", "files", "file", "unread", "today", "tomorrow"}


def normalise_message(message: str) -> str:
    """One line without blanks too many, polite openings or closing signs."""
    text = " ".join(message.split()).rstrip("?!. ")
    while True:
        low = text.lower()
        lead = next((p for p in POLITE if low.startswith(p) and not low[len(p) : len(p) + 1].isalnum()), None)
        if lead is None:
            return text
        text = text[len(lead) :].lstrip(" ,")


@dataclass
class Hints:
    text: str
    literals: dict[str, list[str]] = field(default_factory=dict)
    windows: list[Window] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    points_back: bool = False
    asks_to_write: bool = False
    structural: bool = False


def is_structural(text: str, windows: list[Window]) -> bool:
    """Whether nothing but filters is asked for: all words outside phrases of time belong to the structure."""
    for w in windows:
        text = text.replace(w.text, " ")
    words = [w.strip(".,?!'\"").lower() for w in text.split()]
    return all(w in STRUCTURE for w in words if w)


def hints(message: str, clock: Clock) -> Hints:
    """Everything at once; none of it needs a model or a table."""
    text = normalise_message(message)
    words = [w.strip(".,?!'\"").lower() for w in text.split()]
    windows = scan(text, clock)
    return Hints(text, literals(text), windows, kind_words(text)[1], list(dict.fromkeys(LABELS[w] for w in words if w in LABELS)), not DEIXIS.isdisjoint(words), bool(words) and words[0] in WRITES, is_structural(text, windows))


def services_missing(named: list[str], allowed: list[str]) -> list[str]:
    """Services that a plan names and may not use, in their order."""
    return [x for x in dict.fromkeys(named) if x not in set(allowed)]
