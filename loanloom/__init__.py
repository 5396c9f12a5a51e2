"""loanloom: consumer-credit analytics expressed as Spark DataFrame jobs."""

from loanloom.errors import ContractError

__all__ = ["ContractError"]
__version__ = "0.1.0"
