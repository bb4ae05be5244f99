from vicinal.sources.scratch import clear_scratch, scratch_path, stored
from vicinal.sources.tables import table

__all__ = ["clear_scratch", "scratch_path", "stored", "table"]
