"""Names for columns that an operator uses on the way."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(wish: str, taken: Iterable[str]) -> str:
    """``wish``, or ``wish`` with underscores in front until it is none of ``taken`` (in any case)."""
    used = {name.lower() for name in taken}
    while wish.lower() in used:
        wish = "_" + wish
    return wish
