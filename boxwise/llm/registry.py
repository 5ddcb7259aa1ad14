"""What ``__spark_entry__`` registers from this subpackage."""

from __future__ import annotations

from boxwise.llm.oracles import ORACLES
from boxwise.llm.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
