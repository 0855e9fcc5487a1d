"""Tables cut from their lineage, for the corpus operators."""

from lattica.tables import cut, delete, folder, new_path, scratch

__all__ = ["cut", "delete", "folder", "new_path", "scratch"]
