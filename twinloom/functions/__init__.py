"""Scalar and aggregate expressions with the twin's exact semantics, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinloom.model import OPEN, PROVENANCE

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ENDLESS = r"(?i)^[+-]?inf(inity)?$"
_NAN = r"(?i)^[+-]?nan$"
#: OPC UA codes of the units that have one (fixed values).
UNIT_CODES = {"A": 267608, "C": 259827, "°C": 259827, "m/s": 259875, "mm/s": 266899, "bar": 259853, "V": 268041}
#: Seconds from 1601 to 1970, and 100 ns ticks in a second (fixed values).
UA_EPOCH, UA_TICKS = 11_644_473_600, 10_000_000


def strict_double(text: Column) -> Column:
    """A decimal number, infinity or NaN as double; null for anything else, blanks and type suffixes included."""
    sign = F.when(F.startswith(text, F.lit("-")), -1.0).otherwise(1.0)
    return (
        F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))
        .when(F.rlike(text, F.lit(_ENDLESS)), sign * F.lit(float("inf")))
        .when(F.rlike(text, F.lit(_NAN)), F.lit(float("nan")))
    )


def prop(props: Column, key: str) -> Column:
    """The first value under key, or null."""
    return F.try_element_at(F.filter(props, lambda p: p["k"] == key), F.lit(1))["v"]


def valid_at(valid_from: Column, valid_to: Column, at: int | Column) -> Column:
    """Whether [valid_from, valid_to) holds the instant."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (valid_from <= at) & ((valid_to == OPEN) | (at < valid_to))


def provenance_name(byte: Column) -> Column:
    out = None
    for i, name in enumerate(PROVENANCE):
        out = F.when(byte == i, name) if out is None else out.when(byte == i, name)
    return out.otherwise("Unknown")


def comparable(byte: Column) -> Column:
    """Whether a value of this class may be held against a specification: only observations may."""
    return byte == PROVENANCE.index("Observation")


def source_provenance(source: Column) -> Column:
    """0 for data of a controller, 1 for those of agents and sensors, null for other sources."""
    return F.when(source == "plc", 0).when(source.isin("agent", "sensor"), 1)


def topology_of(relation_type: Column) -> Column:
    """What stands before the first colon; '' without one."""
    return F.when(F.contains(relation_type, F.lit(":")), F.substring_index(relation_type, ":", 1)).otherwise("")


def type_of(relation_type: Column) -> Column:
    """What stands after the first colon; the whole without one."""
    return F.when(F.contains(relation_type, F.lit(":")), F.substring(relation_type, F.instr(relation_type, ":") + 1, F.length(relation_type))).otherwise(relation_type)


def joined_type(topology: Column, rel_type: Column) -> Column:
    return F.when(topology == "", rel_type).otherwise(F.concat(topology, F.lit(":"), rel_type))


def series_name(entity: Column, signal: str | Column) -> Column:
    return F.concat(entity, F.lit("."), signal if isinstance(signal, Column) else F.lit(signal))


def series_id(name: Column) -> Column:
    return F.xxhash64(name)


def shown_number(x: Column) -> Column:
    """As reports show numbers: whole ones below 1e15 without a point, never an exponent, '-' for null."""
    plain = F.rtrim(F.format_string("%.17f", x), F.lit("0"))
    text = x.cast("string")
    text = F.when(F.contains(text, F.lit("E")), plain).otherwise(text)
    return F.when(x.isNull(), "-").when((x == F.rint(x)) & (F.abs(x) < 1e15), x.try_cast("bigint").cast("string")).otherwise(text)


def clipped(text: Column, most: int = 20) -> Column:
    """The longest beginning of whole characters that takes at most so many UTF-8 bytes."""
    sizes = F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.substring(text, F.lit(1), i))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.array_max(F.transform(F.filter(sizes, lambda s: F.octet_length(s) <= most), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"])


def decoded_props(raw: Column) -> Column:
    """Props stored as 'k=v' parts that end in NUL, in order; a part without '=' has an empty value."""
    parts = F.filter(F.split(raw, "\u0000"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("").alias("v")))


def unit_code(unit: Column) -> Column:
    """The unit's code, or 100 and the sum of its bytes modulo 100000."""
    out = None
    for name, code in UNIT_CODES.items():
        out = F.when(unit == name, code) if out is None else out.when(unit == name, code)
    total = F.aggregate(F.sequence(F.lit(1), F.octet_length(unit)), F.lit(0), lambda a, i: a + F.conv(F.hex(F.substring(F.encode(unit, "UTF-8"), i, F.lit(1))), 16, 10).cast("int"))
    return out.otherwise(F.when(F.octet_length(unit) > 0, 100 + total % 100_000).otherwise(100))


def ua_ticks(t: Column) -> Column:
    return (t + UA_EPOCH) * UA_TICKS


def zigzag(x: Column) -> Column:
    """Signed to unsigned as varints do it; 64 bits."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1))))


def varint_size(x: Column) -> Column:
    """Bytes of an unsigned varint: one for each begun seven bits."""
    return F.when(x == 0, 1).when(x < 0, 10).otherwise(F.ceil((F.floor(F.log2(x.cast("double")) + 1e-12) + 1) / 7).cast("int"))


def real(v: Column) -> Column:
    """v without NaN, which maxima and minima skip."""
    return F.when(~F.isnan(v), v)


def aggregate(kind: str, v: Column) -> Column:
    """max, min, avg, sum or count of values; the sum of none is 0, the count a double, the others null."""
    return {
        "max": lambda: F.max(real(v)), "min": lambda: F.min(real(v)), "avg": lambda: F.avg(v),
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)), "count": lambda: F.count(v).cast("double"),
    }[kind]()
