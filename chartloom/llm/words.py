"""Words of texts: runs of letters and digits in lower case, whatever stands between them."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of ``text``; none of a null."""
    return WORD.findall(text.lower()) if text else []
