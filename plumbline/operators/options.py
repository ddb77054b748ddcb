"""Options as users write them."""

from __future__ import annotations

from plumbline.operators.profile import column_numbers

#: Words that mean yes; modes of companions and of alignment, and other names for them.
YES = ("1", "true", "yes", "on", "да")
COMPANION_MODES = ("auto", "none", "left", "right", "between")
NORMALIZED_MODES = ("normalized", "normalised", "normalization", "normalize", "post_normalize", "post-normalize", "alignment_normalization", "alignment+normalization")


def yes(value: object, default: bool = False) -> bool:
    """True for a word that means yes, the default for nothing, else False."""
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower() if value is not None else ""
    return text in YES if text else default


def companion_mode(value: object) -> str:
    """One of COMPANION_MODES; anything else is auto."""
    text = str(value or "").strip().lower()
    return text if text in COMPANION_MODES else "auto"


def alignment_mode(value: object) -> str:
    """normalized by any of its names, fast for nothing, else what it says."""
    text = str(value or "").strip().lower()
    return "normalized" if text in NORMALIZED_MODES else text or "fast"


def companion_groups(spec: str, width: int) -> dict[int, list[int]]:
    """`C=D:E; F=G` as columns by target, numbers from 1; a target named twice gathers both."""
    out: dict[int, list[int]] = {}
    for group in filter(None, (g.strip() for g in spec.split(";"))):
        target, sign, columns = group.partition("=")
        if not sign:
            raise ValueError(f"no companions in {group}")
        (number,) = column_numbers(target, width)
        known = out.setdefault(number, [])
        known += [n for n in column_numbers(columns, width) if n not in known and n != number]
    return out
