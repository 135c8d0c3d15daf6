"""Written intermediate tables in the folder that the cluster shares (see :mod:`bazaarspark.sources.scratch`)."""

from bazaarspark.sources.scratch import drop, shared_folder, written

__all__ = ["drop", "shared_folder", "written"]
