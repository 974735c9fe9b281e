"""Plan-level helpers: lineage cuts, size-checked joins, the package's way to the workers."""

from lawloom.plans.stage import is_small, join_unique, new_folder, release, scope, shared_dir, spread_out, staged

__all__ = ["is_small", "join_unique", "new_folder", "release", "scope", "shared_dir", "spread_out", "staged"]
