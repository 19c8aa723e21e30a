"""Files that tasks write and read in the shared folder, as :mod:`playtrail.task_files` has them."""

from __future__ import annotations

from playtrail.task_files import new_file, open_file, open_folder

__all__ = ["new_file", "open_file", "open_folder"]
