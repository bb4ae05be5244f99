from vicinal.plans.operators import rewrite, sql
from vicinal.plans.strategy import choose_strategy, search

__all__ = ["choose_strategy", "rewrite", "search", "sql"]
