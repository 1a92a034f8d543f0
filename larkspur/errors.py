"""What can go wrong, one class a kind."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of this engine."""


class SqlError(EngineError):
    """A statement could not be read; ``at`` is the byte where it went wrong."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} (at byte {at})")
        self.message, self.at = message, at


class Unsupported(EngineError):
    """A statement asks for what this engine does not do."""


class UnknownTable(EngineError):
    """No table has this name."""


class UnknownColumn(EngineError):
    """No column in scope has this name."""


class AmbiguousColumn(EngineError):
    """More than one column in scope has this name."""


class TableExists(EngineError):
    """The table's name is taken."""


class IndexExists(EngineError):
    """The index's name is taken in its table."""


class NotNull(EngineError):
    """A null was to be written where none may be."""


class NotUnique(EngineError):
    """A key was to be written twice where it may stand once."""


class TypeMismatch(EngineError):
    """A value does not fit its column."""

    def __init__(self, column: str, wanted: str, found: str):
        super().__init__(f"column {column} holds {wanted}, not {found}")
        self.column, self.wanted, self.found = column, wanted, found


class Overflow(EngineError):
    """Whole-number arithmetic left 64 bits."""


class TransactionAlreadyOpen(EngineError):
    """BEGIN within a transaction."""


class NoOpenTransaction(EngineError):
    """COMMIT or ROLLBACK without a transaction."""


class CommitConflict(EngineError):
    """Another writer committed since this transaction began."""


class CorruptStore(EngineError):
    """A manifest could not be read."""
