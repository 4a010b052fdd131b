"""Intermediate tables in the folder that driver and executors share (see ``quarry.store``)."""

from quarry.store import Rolling, in_buckets, clear, fresh_path, materialise, scope, shared_dir

__all__ = ["Rolling", "in_buckets", "clear", "fresh_path", "materialise", "scope", "shared_dir"]
