"""Messages and exceptions shared by all operators."""

# Texts that callers of the original SQL surface match on.
DIFFERENT_DIMENSIONS = "different array dimensions %d and %d"
WRONG_DIMENSIONS = "Wrong number of dimensions: %d instead of %d expected"
INSERT_FAILED = "HNSW index insert failed"
SEARCH_FAILED = "HNSW index search failed"
DIMS_REQUIRED = "HNSW index requires 'dims' to be specified"


class IndexOptionError(ValueError):
    """An index option is missing, out of range, or may not be changed."""


class IndexDataError(RuntimeError):
    """Stored index data and its metadata do not agree."""
