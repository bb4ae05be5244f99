from vicinal.streaming.ingest import ingest

__all__ = ["ingest"]
