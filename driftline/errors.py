"""Error types raised by the operators.

One base class, so that a job can tell a data problem from a Spark problem.
"""


class DriftlineError(Exception):
    """Base of all errors raised by this package."""


class SourceError(DriftlineError):
    """A table, file or address could not be read."""


class InvalidUrlError(SourceError):
    """An address is malformed or uses an unsupported scheme."""


class DataError(DriftlineError):
    """The data or a validation parameter is not acceptable."""


class EmptyDataError(DataError):
    """The input has no rows."""


class InsufficientDataError(DataError):
    """Fewer rows are left than the caller asked for."""


class MissingColumnError(DataError):
    """A required column is absent."""


class FeatureError(DriftlineError):
    """Feature engineering cannot go on."""


class TrainingError(DriftlineError):
    """Training or scoring cannot go on."""


class RegistrationError(DriftlineError):
    """A model cannot be registered or resolved."""


class ThresholdError(RegistrationError):
    """A registration threshold is outside its range."""
