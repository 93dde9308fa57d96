"""tollgate: risk scoring of payment transactions as Spark DataFrame jobs."""

from tollgate.params import Params

__all__ = ["Params"]
