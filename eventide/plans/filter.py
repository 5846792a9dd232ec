"""The event filter: what to look for, checked and completed before it becomes a plan."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from eventide.errors import InvalidFilter
from eventide.schema import DEFAULT_KINDS, DEFAULT_LIMIT

MOST_KINDS, MOST_TAG_VALUES = 100, 1000


@dataclass(frozen=True)
class EventFilter:
    """A conjunction of conditions; an empty one is no condition.

    ``since`` and ``until`` are unix seconds, both included, 0 for none. ``tags`` maps a name to values:
    any value of a name will do, all names must be met. ``limit`` 0 stands for the default, None for none.
    ``ids`` asks for events by id.
    """

    kinds: tuple[int, ...] = ()
    authors: tuple[Any, ...] = ()
    since: int = 0
    until: int = 0
    tags: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    search: str = ""
    limit: int | None = 0
    ids: tuple[Any, ...] = ()

    def __post_init__(self) -> None:
        for name in ("kinds", "authors", "ids"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        object.__setattr__(self, "tags", {k: tuple(v) for k, v in self.tags.items()})

    @property
    def wanted_tags(self) -> dict[str, tuple[str, ...]]:
        """Tag conditions; a name without values is none."""
        return {k: v for k, v in self.tags.items() if v}

    def with_tag(self, name: str, *values: str) -> EventFilter:
        """Itself with further values of a tag."""
        return dataclasses.replace(self, tags={**self.tags, name: (*self.tags.get(name, ()), *values)})

    def get_tag(self, name: str) -> tuple[str, ...]:
        return self.tags.get(name, ())

    def with_hashtags(self, *values: str) -> EventFilter:
        return dataclasses.replace(self, tags={**self.tags, "t": values})

    def with_events(self, *values: str) -> EventFilter:
        return dataclasses.replace(self, tags={**self.tags, "e": values})

    def with_people(self, *values: str) -> EventFilter:
        return dataclasses.replace(self, tags={**self.tags, "p": values})

    def validate(self) -> EventFilter:
        """Itself; InvalidFilter if it makes no sense."""
        if self.limit is not None and self.limit < 0:
            raise InvalidFilter("the limit is negative")
        nothing = not (self.kinds or self.authors or self.since or self.until or self.tags or self.search or self.ids)
        if nothing and self.limit == 0:
            raise InvalidFilter("the filter has no condition and no limit")
        if len(self.kinds) > MOST_KINDS:
            raise InvalidFilter(f"more than {MOST_KINDS} kinds")
        for name, values in self.tags.items():
            if not name:
                raise InvalidFilter("a tag has no name")
            if len(values) > MOST_TAG_VALUES:
                raise InvalidFilter(f"more than {MOST_TAG_VALUES} values of tag {name}")
        if self.since and self.until and self.since > self.until:
            raise InvalidFilter("since lies after until")
        return self

    def normalize(self, default_limit: int = DEFAULT_LIMIT, default_kinds: Iterable[int] = DEFAULT_KINDS) -> EventFilter:
        """A copy with the default limit for 0, and the default kinds where authors or tags are asked for without kinds."""
        limit = default_limit if self.limit == 0 else self.limit
        kinds = self.kinds or (tuple(default_kinds) if self.authors or self.tags else ())
        return dataclasses.replace(self, limit=limit, kinds=kinds)


def user_timeline(author: Any, limit: int = 0) -> EventFilter:
    return EventFilter(authors=(author,), limit=limit)


def kind_timeline(kind: int, limit: int = 0) -> EventFilter:
    return EventFilter(kinds=(kind,), limit=limit)


def replies(event: str, limit: int = 0) -> EventFilter:
    """Events that refer to an event."""
    return EventFilter(tags={"e": (event,)}, limit=limit)


def mentions(person: str, limit: int = 0) -> EventFilter:
    """Events that refer to a person."""
    return EventFilter(tags={"p": (person,)}, limit=limit)


def hashtag(tag: str, limit: int = 0) -> EventFilter:
    return EventFilter(tags={"t": (tag,)}, limit=limit)


def bounded_timeline(since: int, until: int, limit: int = 0) -> EventFilter:
    return EventFilter(since=since, until=until, limit=limit)


def event_by_id(event: Any) -> EventFilter:
    return EventFilter(ids=(event,), limit=1)


def matches(event: Mapping[str, Any], f: EventFilter) -> bool:
    """The filter's meaning for one event in plain Python, to compare plans with."""
    tags = event["tags"] or []
    fold = lambda n, v: v.lower() if n == "t" else v
    return (
        (not f.ids or event["id"] in f.ids) and (not f.kinds or event["kind"] in f.kinds) and (not f.authors or event["pubkey"] in f.authors)
        and (not f.since or event["created_at"] >= f.since) and (not f.until or event["created_at"] <= f.until)
        and all(any(len(t) >= 2 and t[0] == n and fold(n, t[1]) in {fold(n, v) for v in vs} for t in tags) for n, vs in f.wanted_tags.items())
        and (not f.search or f.search.lower() in event["content"].lower() or any(f.search.lower() in v.lower() for t in tags for v in t[1:]))
    )
