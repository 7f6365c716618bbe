from .export import export_layout
from .tables import high_water_mark, incremental_slice, load, load_csv, staged_projection

__all__ = ["export_layout", "high_water_mark", "incremental_slice", "load", "load_csv", "staged_projection"]
