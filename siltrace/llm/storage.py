"""Tables written between steps, in the folder that all executors share."""

from siltrace.sources.stored import dropped, shared_dir, written

__all__ = ["dropped", "shared_dir", "written"]
