"""Threat hunting over shell commands, written as Spark DataFrame transforms."""

from shellsieve.session import hunt_session

__all__ = ["hunt_session"]
