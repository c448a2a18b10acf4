"""Property sheets of resources: (name, value) rows from the payloads of create tokens, in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import enums, scalars

#: Fixed values of the format: by resource type the rows of its sheet as (property, high bit, low bit, how it is shown).
#: number: as it is; next: plus one; power: 2 to it; bytes, chunks (of 4 KiB), pages (2 to it): a memory text; flag: True or False.
SHEETS: dict[int, tuple[tuple[str, int, int, str], ...]] = {
    0: (
        ("Create flags", 19, 0, "IMAGE_CREATION"), ("Usage flags", 34, 20, "IMAGE_USAGE"), ("Image type", 36, 35, "IMAGE_TYPES"), ("X Dimension", 50, 37, "next"), ("Y Dimension", 64, 51, "next"), ("Z Dimension", 78, 65, "next"),
        ("Format", 98, 91, "FORMATS"), ("Swizzle", 90, 79, "swizzle"), ("Mip levels", 102, 99, "number"), ("Slices", 113, 103, "next"), ("Sample count", 116, 114, "power"), ("Fragment count", 118, 117, "power"),
        ("Tiling type", 120, 119, "TILINGS"), ("Tiling optimization mode", 122, 121, "TILING_MODES"), ("Metadata mode", 124, 123, "number"), ("Max base alignment", 129, 125, "pages"), ("Image size", 162, 131, "bytes"), ("Image alignment", 295, 291, "pages"),
        ("Metadata head offset", 258, 227, "bytes"), ("Metadata head size", 290, 259, "bytes"), ("Metadata head alignment", 305, 301, "pages"), ("Metadata tail offset", 194, 163, "bytes"), ("Metadata tail size", 226, 195, "bytes"), ("Metadata tail alignment", 300, 296, "pages"),
        ("Presentable", 130, 130, "flag"), ("Fullscreen", 306, 306, "flag"),
    ),
    1: (("Create flags", 7, 0, "BUFFER_CREATION"), ("Usage flags", 23, 8, "BUFFER_USAGE"), ("Size", 87, 24, "bytes")),
    2: (("Flags", 7, 0, "GPU_EVENT"),),
    3: (("Size in entries", 7, 0, "number"),),
    6: (("SPM memory size", 31, 0, "bytes"), ("SQTT memory size", 63, 32, "bytes"), ("Counter memory size", 95, 64, "bytes")),
    7: (("Heap type", 1, 0, "number"), ("Enable CPU access", 2, 2, "flag")),
    8: (("Engine type", 3, 0, "number"), ("Decoder type", 7, 4, "number"), ("Width", 19, 8, "next"), ("Height", 31, 20, "next")),
    9: (("Engine type", 3, 0, "number"), ("Encoder type", 4, 4, "number"), ("Width", 16, 5, "next"), ("Height", 28, 17, "next"), ("Format", 48, 41, "FORMATS")),
    11: (("Flags", 4, 0, "number"), ("Size", 68, 5, "bytes"), ("Alignment", 73, 69, "number"), ("Segment index", 77, 74, "number")),
    12: (("Create flags", 7, 0, "PIPELINE_CREATION"), ("Internal Pipeline hash", 135, 8, "hash"), ("Stage mask", 143, 136, "PIPELINE_STAGES"), ("Is NGG", 144, 144, "flag")),
    13: (("Descriptor Type", 3, 0, "number"), ("Shader visible", 4, 4, "flag"), ("GPU mask", 12, 5, "number"), ("Num descriptors", 28, 13, "number")),
    14: (("Max sets", 15, 0, "number"), ("Pools count", 23, 16, "number")),
    15: (
        ("Flags", 3, 0, "COMMAND_ALLOCATOR"), ("Executable preferred heap", 7, 4, "number"), ("Executable size", 63, 8, "chunks"), ("Executable suballoc size", 119, 64, "chunks"), ("Embedded preferred heap", 123, 120, "number"), ("Embedded size", 179, 124, "chunks"),
        ("Embedded suballoc size", 235, 180, "chunks"), ("GPU scratch preferred heap", 239, 236, "number"), ("GPU scratch size", 295, 240, "chunks"), ("GPU scratch suballoc size", 351, 296, "chunks"),
    ),
}
FLAGS = ("IMAGE_CREATION", "IMAGE_USAGE", "BUFFER_CREATION", "BUFFER_USAGE", "GPU_EVENT", "PIPELINE_CREATION", "PIPELINE_STAGES", "COMMAND_ALLOCATOR")
WIDEST = 48  # bits that are read of a number: no address space is larger


def bits(payload: str, first: str, size: str, shift: str, mask: str) -> str:
    """SQL: the unsigned number in a bit range of a little-endian payload, from `size` bytes at `first`."""
    byte = f"cast(conv(hex(substring({payload}, {first} + k + 1, 1)), 16, 10) AS long)"
    return f"(shiftright(aggregate(sequence(0, {size} - 1), 0L, (n, k) -> n + shiftleft({byte}, 8 * k)), {shift}) & {mask})"


def _specification(spark: SparkSession) -> DataFrame:
    """The rows of all sheets as a table; of ranges wider than WIDEST bits the lowest count."""
    rows = []
    for kind, sheet in SHEETS.items():
        for place, (name, high, low, how) in enumerate(sheet):
            top = min(high, low + WIDEST - 1)
            names = list(enums.SWIZZLES if how == "swizzle" else getattr(enums, how, ()))
            rows.append((kind, place, name, "flags" if how in FLAGS else "name" if how.isupper() else how, low // 8, top // 8 - low // 8 + 1, low % 8, (1 << top - low + 1) - 1, names))
    return spark.createDataFrame(rows, "resource_type int, place int, property string, _how string, _first int, _size int, _shift int, _mask long, _names array<string>")


def properties(creates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, property, value) of create tokens with resource_type and payload, one row for each row of the type's sheet; types without one have none.

    Embedded data and scratch memory each show their own fields. Descriptor pools' further
    descriptions aren't rows. A payload that ends before a field gives a null value.
    """
    rows = F.broadcast(_specification(creates.sparkSession))  # fixed: less than a hundred rows
    each = creates.select(*keys, F.col("resource_type").cast("int").alias("resource_type"), "payload").join(rows, "resource_type")
    each = each.withColumn("_v", F.expr(bits("payload", "_first", "_size", "_shift", "_mask")))
    word = lambda at: f"lower(array_join(transform(sequence(0, 7), k -> hex(substring(payload, _first + {at} - k, 1))), ''))"
    each = each.withColumns({"_upper": F.when(F.col("_how") == "hash", F.expr(word(8))), "_lower": F.when(F.col("_how") == "hash", F.expr(word(16)))})
    value, zero = F.col("_v"), "0" * 16
    names = F.expr("concat_ws(' | ', filter(transform(_names, (n, k) -> if(shiftright(_v, k) & 1 = 1, n, NULL)), n -> n IS NOT NULL))")
    power = F.expr("shiftleft(1L, cast(_v AS int))")
    shown = {
        "flags": F.when(value == 0, "None").otherwise(F.concat(names, F.lit(" ("), value.cast("string"), F.lit(")"))),
        "name": F.coalesce(F.expr("get(_names, cast(_v AS int))"), F.lit("Unknown")),
        "swizzle": F.expr("array_join(transform(sequence(0, 3), k -> coalesce(get(_names, cast(shiftright(_v, 3 * k) & 7 AS int)), 'Unknown')), '')"),
        "number": F.format_number(value, 0), "next": F.format_number(value + 1, 0), "power": F.format_number(power, 0), "flag": F.when(value == 1, "True").otherwise("False"),
        "bytes": scalars.memory_text(value), "chunks": scalars.memory_text(value * 4096), "pages": scalars.memory_text(power),
        "hash": F.when(F.col("_upper") != zero, F.concat("_upper", "_lower")).when(F.col("_lower") != zero, F.col("_lower")).otherwise("N/A"),
    }
    text = None
    for how, column in shown.items():
        text = F.when(F.col("_how") == how, column) if text is None else text.when(F.col("_how") == how, column)
    return each.select(*keys, "place", "property", F.when(value.isNotNull(), text).alias("value"))
