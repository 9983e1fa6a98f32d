"""Scalar column functions."""
from gridcast.functions.scalar import *  # noqa: F401,F403
