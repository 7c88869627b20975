"""Errors a query can raise before anything runs."""


class ProgramError(ValueError):
    """The text isn't a program; says where, as line and column from 1."""

    def __init__(self, message: str, text: str = "", at: int | None = None) -> None:
        if at is not None:
            line = text.count("\n", 0, at) + 1
            column = at - (text.rfind("\n", 0, at) + 1) + 1
            message = f"{line}:{column}: {message}"
        super().__init__(message)


class KindError(ProgramError):
    """An operator got a kind of value that it can't work on."""
