"""Written tables in the shared folder, as the library has them."""

from __future__ import annotations

from ..storage import shared_dir, written

__all__ = ["shared_dir", "written"]
