"""tidewatch: network-flow threat analytics as PySpark DataFrame jobs."""

from tidewatch.session import get_session

__all__ = ["get_session"]
