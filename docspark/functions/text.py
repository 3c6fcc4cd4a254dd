"""Scalar text and geometry expressions: Column to Column."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as blank in searches (no U+0085).
BLANKS = "\t\n\x0b\x0c\r    -     　﻿"


def normalize_line_endings(c: Column) -> Column:
    """CRLF and CR to LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def collapse_whitespace(c: Column) -> Column:
    """Runs of blanks to one space, none at either end."""
    return F.trim(F.regexp_replace(c, f"[{BLANKS}]+", " "))


def extraction_text(c: Column) -> Column:
    """Runs of spaces to one, none at the end."""
    return F.rtrim(F.regexp_replace(c, " {2,}", " "))


@cache
def folds() -> dict[str, str]:
    """Every character whose default case folding is another text, with that text, by this Python's Unicode tables."""
    return {c: c.casefold() for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (c := chr(i)).casefold() != c}


def casefold(c: Column, joint: str = "") -> Column:
    """Default case folding of all characters: one to one, and to several where a text holds such a character.

    joint, a character, is set between the several ones of a single character; where it stands in the text itself, the next
    character in code-point order takes its place.
    """
    lone, wide = ({k: v for k, v in folds().items() if (len(v) == 1) == one} for one in (True, False))
    moved = {joint: chr(ord(joint) + 1)} if joint else {}
    out = F.translate(c, "".join([*lone, *moved]), "".join([*lone.values(), *moved.values()]))
    several = out
    for k, v in wide.items():
        several = F.replace(several, F.lit(k), F.lit(joint.join(v)))
    return F.when(out.rlike(f"[{''.join(wide)}]"), several).otherwise(out)


def list_marker(c: Column) -> Column:
    """Whether the first token is a list marker: a bullet, 12. or (a) or IV) and the like."""
    return F.ltrim(c).rlike(r"^(?:[-•‣◦]|\(?(?:[0-9]{1,3}|[A-Za-z]|[IVXLCDMivxlcdm]{1,8})[.)])(?:\s|$)")


def display_transform(x: Column, y: Column, w: Column, h: Column, rotation: Column, inverse: bool = False) -> tuple[Column, Column]:
    """A point of a page of size w x h in displayed coordinates under the page's rotation, or back."""
    if inverse:
        rotation = F.pmod(360 - rotation, F.lit(360))
        w, h = F.when(rotation % 180 == 90, h).otherwise(w), F.when(rotation % 180 == 90, w).otherwise(h)
    nx = F.when(rotation == 90, h - y).when(rotation == 180, w - x).when(rotation == 270, y).otherwise(x)
    ny = F.when(rotation == 90, x).when(rotation == 180, h - y).when(rotation == 270, w - x).otherwise(y)
    return nx, ny


def visible_rect(x: Column, y: Column, w: Column, h: Column, cx: Column, cy: Column, cw: Column, ch: Column) -> Column:
    """The part of a rectangle inside a crop, null unless both sides are positive."""
    left, top = F.greatest(x, cx), F.greatest(y, cy)
    width, height = F.least(x + w, cx + cw) - left, F.least(y + h, cy + ch) - top
    return F.when((width > 0) & (height > 0), F.struct(left.alias("x"), top.alias("y"), width.alias("width"), height.alias("height")))


def crop_from_margins(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column) -> Column:
    """The crop that margins leave of a page, null if a side is shorter than 1."""
    cw, ch = w - left - right, h - top - bottom
    return F.when((cw >= 1) & (ch >= 1), F.struct(left.alias("x"), top.alias("y"), cw.alias("width"), ch.alias("height")))


def validate_crop(x: Column, y: Column, cw: Column, ch: Column, w: Column, h: Column, minimum: float = 1.0) -> Column:
    """Why a crop is not allowed, null if it is."""
    edge = 4 * 2.220446049250313e-16 * F.greatest(w, h)
    return F.when((cw < minimum) | (ch < minimum), "too_small").when((x < -edge) | (y < -edge) | (x + cw > w + edge) | (y + ch > h + edge), "outside_page")


def selection_id(source_hash: Column, page: Column, *payload: Column) -> Column:
    """A stable id of a selection bound to its source, page and payload."""
    return F.sha2(F.concat_ws("\n", source_hash, page.cast("string"), *[p.cast("string") for p in payload]), 256)
