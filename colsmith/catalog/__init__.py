"""All registered queries."""
from . import tables, profiles, relations, synthesis, coding, learning  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
