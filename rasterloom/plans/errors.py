"""Errors by what caused them. Row errors of plans are texts in an ``error`` column; these stop a call on the driver."""


class EngineError(Exception):
    pass


class SpecError(EngineError, ValueError):
    """A request that says something impossible."""


class ProviderError(EngineError, RuntimeError):
    """Input that cannot be had."""


class ModelError(EngineError, ValueError):
    """A model that is not known, cannot do what is asked, or gave something else."""
