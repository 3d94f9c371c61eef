"""Working tables of the operators of this subpackage."""

from sievework.sources.work import shared_dir, stored

__all__ = ["shared_dir", "stored"]
