"""A select-project-join engine on Spark: small SQL dialect, fluent API, one query model, DataFrames underneath."""

from conjunx.engine import Engine
from conjunx.plans.builder import Select
from conjunx.plans.dialect import DialectError

__all__ = ["DialectError", "Engine", "Select"]
