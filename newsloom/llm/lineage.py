"""Intermediate tables, as the core has them."""

from ..lineage import cut, delete, drop, new_path, shared_dir

__all__ = ["cut", "delete", "drop", "new_path", "shared_dir"]
