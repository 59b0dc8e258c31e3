"""tripkit: reusable Spark operators for large tables of trip-like records."""

from tripkit.roles import Roles

__all__ = ["Roles"]
