"""What can go wrong, as exception classes."""

from __future__ import annotations


class EventideError(Exception):
    """Base of all errors of this library."""


class EventNotFound(EventideError):
    pass


class EventAlreadyExists(EventideError):
    pass


class EventDeleted(EventideError):
    pass


class InvalidFilter(EventideError, ValueError):
    pass


class InvalidConfig(EventideError, ValueError):
    pass


class ReadOnlyTable(EventideError):
    pass


class TableCorrupted(EventideError):
    pass


def is_not_found(error: BaseException) -> bool:
    return isinstance(error, EventNotFound)


def is_already_exists(error: BaseException) -> bool:
    return isinstance(error, EventAlreadyExists)


def is_corrupted(error: BaseException) -> bool:
    return isinstance(error, TableCorrupted)
