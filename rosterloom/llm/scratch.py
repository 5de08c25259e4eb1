"""Shared scratch tables, as all of rosterloom has them."""

from rosterloom.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
