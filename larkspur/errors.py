"""Errors of the engine, by the phase that raises them."""


class EngineError(Exception):
    """Any error of a statement."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""


class PlanError(EngineError):
    """Names or types of a statement do not fit."""


class ExecError(EngineError):
    """A constraint fails while a statement runs."""


class TxnAbort(EngineError):
    """The lock manager ended a transaction."""
