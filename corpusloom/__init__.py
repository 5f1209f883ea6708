"""Corpus analytics on Spark: text kernels, near-duplicates, contamination, manifest algebra, membership and signals."""

from corpusloom.session import cut, ensure_checkpoint_dir, local_session, table

__all__ = ["cut", "ensure_checkpoint_dir", "local_session", "table"]
