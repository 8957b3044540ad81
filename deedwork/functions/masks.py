"""Identifier masks as anchored regular expressions.

``9`` stands for a digit, ``A`` for an upper-case letter, ``X`` for either, a backslash takes the
next character literally, and anything else stands for itself.
"""

from __future__ import annotations

import re
from itertools import groupby

CLASSES = {"9": "[0-9]", "A": "[A-Z]", "X": "[A-Z0-9]"}


def mask_regex(mask: str) -> str:
    tokens = re.findall(r"\\.|[^\\]", mask)
    if "".join(tokens) != mask:
        raise ValueError("the mask ends in a backslash")
    if not any(t in CLASSES for t in tokens):
        raise ValueError("the mask has no symbol: use 9, A or X")
    out = []
    for token, run in groupby(tokens):
        n = len(list(run))
        if token in CLASSES:
            out.append(CLASSES[token] + (f"{{{n}}}" if n > 1 else ""))
        else:
            out.append(re.escape(token[-1]) * n)
    return "".join(out)


def identifier_regex(*formats: tuple[tuple[str, ...], str]) -> str:
    """One whole-value pattern for alternatives of ``(prefixes, mask)``."""
    each = []
    for prefixes, mask in formats:
        lead = "(" + "|".join(re.escape(p) for p in prefixes) + ")" if prefixes else ""
        each.append(lead + mask_regex(mask))
    return "^(" + "|".join(each) + ")$"
