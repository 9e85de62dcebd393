"""Errors. Messages hold counts, types and rules, never a clear value or a key."""


class RegistryError(RuntimeError):
    """The registry cannot hold what it is asked to."""


class SchemaVersionError(RegistryError):
    """The registry was written by a later version."""


class GazetteerVersionMismatch(RegistryError):
    """The registry belongs to another version of the gazetteers."""


class DomainTooSmallError(ValueError):
    """Too few digits for format-preserving encryption."""


class UnresolvedSpanError(RuntimeError):
    """A strict policy met spans of low confidence."""


class InvariantError(AssertionError):
    """An invariant does not hold."""


class LeakError(InvariantError):
    """A clear value is in a masked text."""


class DeterminismError(InvariantError):
    """One value of a scope has several surrogates."""


class InjectivityError(InvariantError):
    """Several values of a scope share a surrogate."""


class EmittedOnlyError(InvariantError):
    """A surrogate was restored that was never issued."""
