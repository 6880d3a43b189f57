"""Imports every family so that its queries are registered."""

from checks import files, ledger, protocol, runs, search, streams, telemetry  # noqa: F401
from checks.base import CHECKS  # noqa: F401
