"""Errors, each with the exit code of the command line."""


class SlicerError(Exception):
    exit_code = 1


class ConfigError(SlicerError):
    exit_code = 2


class SourceError(SlicerError):
    exit_code = 3


class TargetError(SlicerError):
    exit_code = 4


class IntegrityError(SlicerError):
    exit_code = 5


class HealthError(SlicerError):
    exit_code = 6
