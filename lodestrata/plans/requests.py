"""Requests: what a search accepts, checked before anything runs, with errors that say what is accepted."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from ..operators.filters import read_terms
from ..operators.merging import expand_courts

LONGEST, MOST_FORMULATIONS, MOST_SHOWN = 300, 10, 200


class BadRequest(ValueError):
    """A request that can't be run, and what would do."""


def read_date(text: str | None, name: str) -> dt.date | None:
    """YYYY-MM-DD or dd/mm/yyyy that stands in the calendar."""
    if text is None or not text.strip():
        return None
    t = text.strip()
    for shape, order in ((r"(\d{4})-(\d{2})-(\d{2})", (1, 2, 3)), (r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1))):
        m = re.fullmatch(shape, t)
        if m:
            try:
                return dt.date(*(int(m.group(i)) for i in order))
            except ValueError:
                break
    raise BadRequest(f"{name}: {text!r} is no date; write YYYY-MM-DD or dd/mm/yyyy")


@dataclass(frozen=True)
class Request:
    """A checked search."""

    formulations: tuple[str, ...]
    courts: tuple[str, ...]
    must: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    since: dt.date | None = None
    until: dt.date | None = None
    most: int = 50


def read_request(formulations, courts, must=None, must_not=None, since=None, until=None, most: int = 50, known: frozenset | None = None) -> Request:
    """Formulations without repeats and blanks, courts with groups spread, filters, a period, a size."""
    seen: dict[str, str] = {}
    for f in formulations:
        text = re.sub(r"\s+", " ", f).strip()
        if len(text) > LONGEST:
            raise BadRequest(f"a formulation has {len(text)} characters; {LONGEST} at most")
        if text:
            seen.setdefault(text.lower(), text)
    if not 1 <= len(seen) <= MOST_FORMULATIONS:
        raise BadRequest(f"{len(seen)} formulations; from 1 to {MOST_FORMULATIONS}")
    spread = expand_courts(list(courts))
    strange = [c for c in spread if known is not None and c.lower() not in known]
    if not spread or strange:
        raise BadRequest(f"unknown courts: {', '.join(strange) or 'none given'}")
    a, b = read_date(since, "since"), read_date(until, "until")
    if a and b and a > b:
        raise BadRequest("since is after until")
    if not 1 <= most <= MOST_SHOWN:
        raise BadRequest(f"from 1 to {MOST_SHOWN} rows can be shown")
    try:
        return Request(tuple(seen.values()), tuple(spread), read_terms(must, True), read_terms(must_not, False), a, b, most)
    except ValueError as error:
        raise BadRequest(str(error)) from error
