"""All registered queries of the engine's own operators, with the DuckDB SQL that they equal."""

from __future__ import annotations

from tarnwick.plans import q_content, q_learn, q_params, q_rank, q_render, q_scalar, q_state  # noqa: F401
from tarnwick.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
