"""Names, states and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of a name without one.
DEFAULT_NAMESPACE = "minecraft"


def resource_namespace(name: Column, default: str = DEFAULT_NAMESPACE) -> Column:
    return F.when(F.instr(name, ":") > 0, F.split_part(name, F.lit(":"), F.lit(1))).otherwise(F.lit(default))


def resource_path(name: Column) -> Column:
    return F.when(F.instr(name, ":") > 0, F.substr(name, F.instr(name, ":") + 1)).otherwise(name)


def resource_name(namespace: Column, path: Column) -> Column:
    return F.concat_ws(":", namespace, path)


def state_name(state: Column) -> Column:
    """``name`` of ``name[key=value,...]``."""
    return F.regexp_extract(state, r"^([^\[]*)", 1)


def state_properties(state: Column) -> Column:
    """A map of the properties; empty without any."""
    inner = F.regexp_extract(state, r"\[(.*)\]$", 1)
    return F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(inner, F.lit(","), F.lit("=")))


def state_string(name: Column, properties: Column) -> Column:
    """``name[key=value,...]`` with keys in order; the name alone without properties."""
    parts = F.array_sort(F.transform(F.map_entries(properties), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.when(F.size(parts) > 0, F.concat(name, F.lit("["), F.array_join(parts, ","), F.lit("]"))).otherwise(name)


def property_index(values: Column, value: Column) -> Column:
    """The place of a value in its domain, from 0; -1 if it isn't in it."""
    return (F.array_position(values, value) - 1).cast("int")


def mixed_radix(indices: Column, sizes: Column) -> Column:
    """The number of a state from the indices of its properties; the first property is the fastest."""
    start = F.struct(F.lit(0).cast("long").alias("id"), F.lit(1).cast("long").alias("step"))
    return F.aggregate(F.arrays_zip(indices.alias("i"), sizes.alias("n")), start, lambda a, x: F.struct((a["id"] + a["step"] * x["i"]).alias("id"), (a["step"] * x["n"]).alias("step")), lambda a: a["id"])


def mixed_radix_digits(number: Column, sizes: Column) -> Column:
    """The inverse of mixed_radix()."""
    start = F.struct(number.cast("long").alias("rest"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(sizes, start, lambda a, n: F.struct(F.floor(a["rest"] / n).cast("long").alias("rest"), F.concat(a["out"], F.array(a["rest"] % n)).alias("out")), lambda a: a["out"])


def region_position(path: Column) -> tuple[Column, Column]:
    """Chunk coordinates of a region's origin from its file name ``r.X.Z.mca``; null for other names."""
    def part(k: int) -> Column:
        found = F.regexp_extract(F.regexp_extract(path, r"([^/]*)$", 1), r"^r\.(-?\d+)\.(-?\d+)\.mca$", k)
        return F.when(found != "", found.cast("int") * 32)

    return part(1), part(2)


def extension(path: Column) -> Column:
    """The extension in lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def safe_file_name(name: Column) -> Column:
    """Characters that no file name may have as _."""
    return F.regexp_replace(name, r"[\x00-\x1f<>:\"/\\|?*]", "_")


def inside(path: Column, root: str) -> Column:
    """Whether a relative path stays inside ``root`` (no absolute path, no step out of it)."""
    depth = F.aggregate(
        F.split(path, r"[/\\]"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("least")),
        lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).when((x == ".") | (x == ""), 0).otherwise(1)).alias("d"), F.least(a["least"], a["d"] + F.when(x == "..", -1).otherwise(0)).alias("least")),
        lambda a: a["least"],
    )
    return (depth >= 0) & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:")


def equals_ci(text: Column, other: str) -> Column:
    return F.lower(text) == other.lower()


def starts_with_ci(text: Column, start: str) -> Column:
    return F.lower(text).startswith(start.lower())


def ends_with_ci(text: Column, end: str) -> Column:
    return F.lower(text).endswith(end.lower())


def contains_ci(text: Column, part: str) -> Column:
    return F.lower(text).contains(part.lower())


def is_gzip(content: Column) -> Column:
    """At least 10 bytes that begin with 1F 8B 08."""
    return (F.octet_length(content) >= 10) & (F.hex(F.substring(content, 1, 3)) == "1F8B08")


def duration(seconds: Column) -> Column:
    """1h 2m 3s, without hours below an hour and without minutes below a minute; hours are whole ones."""
    s = seconds.cast("long")
    hours = F.when(s >= 3600, F.concat(F.floor(s / 3600), F.lit("h ")))
    minutes = F.when(s >= 60, F.concat(F.floor(s / 60) % 60, F.lit("m ")))
    return F.concat(F.coalesce(hours, F.lit("")), F.coalesce(minutes, F.lit("")), s % 60, F.lit("s"))


def legacy_state(block: Column, data: Column, add: Column) -> Column:
    """The number of an old state: block << 4 | data, with the block's high bits from ``add``."""
    return F.shiftleft(block.cast("int"), 4).bitwiseOR(data.cast("int")).bitwiseOR(F.shiftleft(add.cast("int"), 12))


def block_reference(literal: Column) -> Column:
    """A setting's block: a number is a legacy id, anything else a name; as struct (id, name)."""
    number = F.try_to_number(literal, F.lit("99999")).cast("int")
    return F.struct(number.alias("id"), F.when(number.isNull(), literal).alias("name"))
