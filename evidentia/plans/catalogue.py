"""All queries of the engine by name, and their DuckDB SQL."""

from evidentia.plans import connectors, evidence, measures, modelling, retrieval, textual, training  # noqa: F401
from evidentia.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
