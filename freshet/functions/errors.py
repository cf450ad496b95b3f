"""Errors of the task plane."""

from __future__ import annotations


class FreshetError(Exception):
    """An error of the user's: shown without a traceback."""


class SignatureError(FreshetError):
    """A rule, matrix or spec that breaks the contract."""


class QueryError(FreshetError):
    """A task query that cannot be compiled."""


class LookupFailed(FreshetError):
    """No task, or more than one, where exactly one is asked for."""


class Defer(Exception):
    """Raised by a deferrable matrix while what it reads is not there."""

    def __init__(self, *paths):
        super().__init__(*paths)
        self.paths = paths
