"""What callers can do wrong, by kind."""


class DomainError(ValueError):
    """An argument or a table that an operator cannot work with."""


class DomainWarning(UserWarning):
    """Something an operator changed or assumed."""
