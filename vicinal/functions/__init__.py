from vicinal.functions.distance import (
    METRICS,
    cosine_distance,
    distance,
    l2_distance,
    manhattan_distance,
    register,
    vector,
)

__all__ = ["METRICS", "cosine_distance", "distance", "l2_distance", "manhattan_distance", "register", "vector"]
