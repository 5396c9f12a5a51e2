"""Errors shared by every layer."""


class ContractError(ValueError):
    """The data breaks a declared contract; no result may be produced from it."""
