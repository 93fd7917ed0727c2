"""Error classes and the status code that a service answers with."""

from __future__ import annotations


class NotFound(LookupError):
    """No row with the asked id or name."""


class Unauthorized(PermissionError):
    """Wrong credentials."""


class Conflict(RuntimeError):
    """A row is still referred to, or a unique key would occur twice."""


class FeedFailure(RuntimeError):
    """A feed can't be read."""


class GeneratorFailure(RuntimeError):
    """A text generator failed; one that names 429 asks to wait."""


class NotReady(RuntimeError):
    """What the operation needs isn't there yet."""


def status_code(error: BaseException) -> int:
    """404, 401, 409, 502, 429, 422 or 400 (wrong arguments), else 500."""
    if isinstance(error, GeneratorFailure):
        return 429 if "429" in str(error) else 502
    for kind, code in ((NotFound, 404), (Unauthorized, 401), (Conflict, 409), (FeedFailure, 502), (NotReady, 422), (ValueError, 400)):
        if isinstance(error, kind):
            return code
    return 500
