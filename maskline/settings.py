"""Settings out of the environment."""

from __future__ import annotations

import os

UPLOAD_ROOT, ORIGINS = "MASKLINE_UPLOAD_ROOT", "MASKLINE_ORIGINS"


def text(name: str, default: str) -> str:
    """A setting without its outer white space; default where it is unset or blank."""
    return os.environ.get(name, "").strip() or default


def entries(name: str, default: tuple[str, ...] = ()) -> list[str]:
    """The entries of a list separated by commas; default where there are none. A lone * is no entry but an error."""
    found = [x.strip() for x in os.environ.get(name, "").split(",") if x.strip()]
    if "*" in found:
        raise ValueError(f"{name} must name its entries; * isn't one")
    return found or list(default)
