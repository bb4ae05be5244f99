"""Exact scan or index: an explicit choice, as Catalyst has no rule for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.operators.exact import nearest
from vicinal.operators.index import AnnIndex

#: Below so many rows the exact scan is taken: starting Python workers costs more than it saves.
EXACT_ROWS = 1_000_000


def choose_strategy(rows: int, k: int | None, index: AnnIndex | None, mode: str = "auto") -> str:
    """``exact`` or ``ann``. An index serves only an ordered, limited search; ``mode`` forces one."""
    if mode not in ("auto", "exact", "ann"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "ann" and index is None:
        raise ValueError("no index to search")
    if mode != "auto":
        return mode
    return "ann" if index is not None and k is not None and rows >= EXACT_ROWS else "exact"


def search(df: DataFrame, column: str, query, k: int, *, id_column: str, metric: str = "l2", index: AnnIndex | None = None, mode: str = "auto") -> DataFrame:
    """``id_column, distance`` of the k nearest rows, by the chosen strategy."""
    if index is not None and index.options.metric != metric:
        raise ValueError(f"the index serves {index.options.metric}, not {metric}")
    rows = index._meta.rows if index is not None else 0
    if choose_strategy(rows, k, index, mode) == "exact":
        return nearest(df, column, query, k, metric=metric, id_column=id_column).select(id_column, "distance")
    found = index.search(query, k).orderBy("rank")
    return found.select(F.col("row_id").alias(id_column), "distance")
