"""Temporal association rules over evolving facts, as Spark plans."""

from . import functions, operators, plans, sources
from .operators import *  # noqa: F403
from .plans import *  # noqa: F403
from .sources import *  # noqa: F403

__all__ = [*operators.__all__, *plans.__all__, *sources.__all__, "functions"]
