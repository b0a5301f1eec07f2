"""Errors of the engine."""


class HalyardError(Exception):
    """Any failed operation."""


class InvalidInput(HalyardError, ValueError):
    """A vector, id or parameter breaks a rule."""


class DuplicateId(HalyardError, ValueError):
    """An id is given twice, or exists already."""


class NotFound(HalyardError, KeyError):
    """No such id or collection."""


class AlreadyExists(HalyardError):
    """A collection of that name exists."""


class CapacityExceeded(HalyardError):
    """A collection would have more rows than it can number."""


class Unsupported(HalyardError):
    """A file is of a version or has values that this engine does not read."""


class Corrupt(HalyardError):
    """A manifest, graph or file is damaged."""
