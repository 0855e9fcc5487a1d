"""Errors of the engine; shape and argument checks raise them before any job runs."""


class EngineError(Exception):
    """Base of all."""


class InvalidSize(EngineError):
    """Shapes that do not fit together."""


class InvalidValue(EngineError):
    """An argument outside its domain."""


class InvalidFile(EngineError):
    """A file that is missing or has the wrong name."""


class InvalidFileFormat(EngineError):
    """A file whose content is not what its format asks for."""


class InvalidSystemSize(EngineError):
    """A linear system that is not square or does not fit its vectors."""
