"""Cutting a text where no token can cross, so that the pieces can be encoded apart."""

from __future__ import annotations

import re

_two_spaces = re.compile(r"\s\s")
_lone_space = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """Pieces that give ``text`` when joined by single spaces.

    The cuts are spaces without another white space beside them. The token pattern takes
    such a space together with what follows it, so encoding the first piece, and every
    other one with its space in front, gives the ids of the whole text.
    """
    if _two_spaces.search(text):
        return _lone_space.split(text)
    return text.split(" ")
