"""Spark-native product search, catalog quality and ranking evaluation."""

from merchlens.session import get_session

__all__ = ["get_session"]
