"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def structural_blank(text: Column) -> Column:
    """White space only, and no form feed, which is a page break and therefore text."""
    return text.rlike(r"(?U)\A\s*\z") & ~F.contains(text, F.lit("\f"))


def json_length(text: Column) -> Column:
    """Code points of the text as a compact JSON string, quotes included."""
    short = F.regexp_count(text, F.lit('["\\\\\\x08\\x0c\\n\\r\\t]'))
    long = F.regexp_count(text, F.lit("[\\x00-\\x07\\x0b\\x0e-\\x1f]"))
    return (F.char_length(text) + 2 + short + 5 * long).cast("long")


def frame(tag: int, value: Column) -> Column:
    """A tag byte, the length in eight bytes, and the bytes: no two lists of frames are the same bytes."""
    size = F.unhex(F.lpad(F.hex(F.octet_length(value)), 16, "0"))
    return F.concat(F.unhex(F.lit(f"{tag:02X}")), size, value.cast("binary"))


def framed_digest(*frames: Column) -> Column:
    return F.sha2(F.concat(*frames), 256)


def frame_all(tag: int, values: Column) -> Column:
    """The frames of an array of strings, one after another."""
    return F.aggregate(values, F.lit("").cast("binary"), lambda acc, v: F.concat(acc, frame(tag, v)))


def unit_name(path: Column, line: Column, unit: Column) -> Column:
    """path:lineN:unitM:text with numbers from 1."""
    return F.format_string("%s:line%d:unit%d:text", path, line, unit)


def language_tag(tag: Column) -> Column:
    """Language lower, script title, region upper; null where a subtag isn't 1 to 8 letters or digits."""
    parts = F.split(tag, "-")
    shaped = F.transform(
        parts,
        lambda p, i: F.when(i == 0, F.lower(p)).when((F.length(p) == 4) & p.rlike("^[A-Za-z]+$"), F.initcap(F.lower(p))).when((F.length(p) == 2) & p.rlike("^[A-Za-z]+$"), F.upper(p)).otherwise(F.lower(p)),
    )
    ok = F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9]{1,8}$")) & F.element_at(parts, 1).rlike("^[A-Za-z]{2,8}$")
    return F.when(ok, F.array_join(shaped, "-"))


def map_number(name: Column) -> Column:
    """The number in a canonical map file name (three digits, or more without a leading zero), else null."""
    number = F.try_to_number(F.regexp_extract(name, r"^Map([0-9]{3}|[1-9][0-9]{3,9})\.json$", 1), F.lit("9999999999")).cast("long")
    return F.when((number >= 1) & (number <= 4294967295), number)


def stable_prefix_locks(path: Column) -> Column:
    """(prefix, access) of every prefix of a path: intent on the way, exclusive at the end."""
    return F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.struct(F.array_join(F.slice(path, F.lit(1), i), "/").alias("resource"), F.when(i == F.size(path), "exclusive").otherwise("intent").alias("access")))


def state_digest(languages: tuple[str, str], ids: list[Column], source: Column, context: Column, bindings: Column, settings: list[Column], hits: Column) -> Column:
    """Digest of everything that an automatic translation rests on: languages, ids, source, group context, bindings, settings and term hits."""
    parts = [frame(1, F.lit(languages[0])), frame(2, F.lit(languages[1])), *[frame(3, i) for i in ids], frame(4, source), frame(5, context), frame(6, bindings), *[frame(7, s) for s in settings], frame_all(8, hits)]
    return framed_digest(*parts)


def manual_digest(group_id: Column, unit_id: Column, path: Column, kind: Column, source: Column) -> Column:
    """Digest of what a manual translation applies to."""
    return framed_digest(frame(1, group_id), frame(2, unit_id), frame(3, path), frame(4, kind), frame_all(5, source))
