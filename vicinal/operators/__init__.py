from vicinal.operators.exact import knn_join, near_join, nearest, range_search, with_distance
from vicinal.operators.index import AnnIndex

__all__ = ["AnnIndex", "knn_join", "near_join", "nearest", "range_search", "with_distance"]
