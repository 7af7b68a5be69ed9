"""Values that an Observation gathered."""

from __future__ import annotations

from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation


def observed(seen: Observation) -> dict[str, Any] | None:
    """The observation's values; None if there are none, because the plan was
    found to be empty before it ran and the observation left out with it."""
    try:
        return seen.get
    except Py4JJavaError:
        return None
