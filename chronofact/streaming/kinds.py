"""The type of a change between two values, for stateful functions."""

from __future__ import annotations

import re

from chronofact.functions.text import NUMERIC


def change_kind(previous: str | None, current: str | None) -> str:
    """The same rule as ``history.change_type``."""
    if previous is None or current is None:
        return "changed" if previous is current else "disclosed" if previous is None else "not_disclosed"
    if re.fullmatch(NUMERIC, previous) and re.fullmatch(NUMERIC, current):
        x, y = float(previous), float(current)
        if x != y:
            return "increased" if y > x else "decreased"
    return "changed"
