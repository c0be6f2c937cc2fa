"""Values to record bytes, as Spark columns. What does not fit is a fault, never cut off or rounded.

A builder returns the field's bytes, as hex digits or as binary (see Piece), and the kind of the
value's fault, null if there is none. All is built-in functions: whole numbers of up to 18
digits are handled as longs, longer ones as decimals, floats by the bits of the JVM's doubles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import SIGN_TABLES, Encoding

WIDE = "decimal(38,0)"

#: What each kind of fault says.
MESSAGES = {
    "null_value": "a null value",
    "field_too_long": "text is too long or has a character outside the charset",
    "unrepresentable_character": "text is too long or has a character outside the charset",
    "zoned_range": "the number does not fit the zoned item",
    "packed_range": "the number does not fit the packed item",
    "binary_range": "the number does not fit the binary item",
    "float_range": "the number does not fit the floating item",
    "scale": "the number does not fit the decimals of the picture",
    "occurs_count": "the elements do not fit the occurrences of the table",
}


@dataclass(frozen=True)
class Piece:
    """Bytes of a record, as a column of hex digits or of binary."""

    column: Column
    is_hex: bool = True

    def hex(self) -> Column:
        return self.column if self.is_hex else F.hex(self.column)

    def binary(self) -> Column:
        return F.unhex(self.column) if self.is_hex else self.column


def joined(pieces: list[Piece]) -> Column:
    """The bytes of pieces one after another; neighbours in hex are turned into bytes at once."""
    parts: list[list[Piece]] = []
    for p in pieces:
        if parts and parts[-1][0].is_hex and p.is_hex:
            parts[-1].append(p)
        else:
            parts.append([p])
    own = [F.unhex(F.concat(*[p.column for p in x])) if len(x) > 1 else x[0].binary() for x in parts]
    return F.concat(*own) if len(own) > 1 else own[0]


def constant(data: bytes) -> Piece:
    return Piece(F.lit(data.hex().upper()))


def alphanumeric(value: Column, width: int, encoding: Encoding, right: bool, fill: bool) -> tuple[Piece, Column]:
    own, text = encoding.chars.unicode, F.coalesce(value.cast("string"), F.lit(""))
    pairs = [(c, chr(b)) for b, c in enumerate(own) if b and c != "\0" and chr(b) != c]
    known = text.rlike("^[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(own)) + "]*$")
    raw = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)) if pairs else text
    raw, pad = F.encode(raw, "ISO-8859-1"), F.lit(bytearray([own.index(" ")]))
    full = F.lpad(raw, F.lit(width), pad) if right else F.rpad(raw, F.lit(width), pad)
    wrong = F.when(value.isNull(), "null_value") if not fill else F.when(F.lit(False), "")
    wrong = wrong.when(F.length(text) > width, "field_too_long").when(~known, "unrepresentable_character")
    return Piece(full, False), wrong


def unscaled(value: Column, kind: T.DataType | None, digits: int, scale: int) -> tuple[Column, Column]:
    """The integer whose scaling by the picture is the value, and whether there is none.

    It is a long for up to 18 digits and else a decimal(38,0); null where the value is null or
    has more digits than that holds.
    """
    narrow = digits <= 18
    if isinstance(kind, T.IntegralType) and scale >= 0:
        v = value.cast("long")
        if narrow:
            return (F.try_multiply(v, F.lit(10**scale).cast("long")) if scale else v), F.lit(False)
    elif isinstance(kind, T.DecimalType) and 0 <= kind.scale <= scale and kind.precision - kind.scale + scale <= 18 and narrow:
        return (value * F.lit(10**scale).cast(T.DecimalType(scale + 1, 0)) if scale else value).cast("long"), F.lit(False)
    places = max(scale, 0)
    held = value.try_cast(T.DecimalType(min(38, max(digits, scale, digits - scale) + 2), places))
    if scale > 0:
        v = held * F.lit(str(10**scale)).cast(T.DecimalType(scale + 1, 0))
        inexact = held != value
    elif scale < 0:
        step = F.lit(str(10**-scale)).cast(T.DecimalType(1 - scale, 0))
        v = held / step
        inexact = (held != value) | (held % step != 0)
    else:
        v, inexact = held, (F.lit(False) if isinstance(kind, T.IntegralType) else held != value)
    v = v.cast(WIDE)
    return (v.try_cast("long") if narrow else v), F.coalesce(inexact, F.lit(False))


def _number(n: int, narrow: bool) -> Column:
    return F.lit(n).cast("long") if narrow else F.lit(str(n)).cast(WIDE)


def _whole(value: Column, kind: T.DataType | None, digits: int, scale: int, least: int, most: int, fault: str, fill: bool) -> tuple[Column, Column]:
    """The unscaled number, zero for a null that is filled, and the kind of its fault."""
    v, inexact = unscaled(value, kind, digits, scale)
    narrow = digits <= 18
    fits = F.coalesce(v.between(_number(least, narrow), _number(most, narrow)), F.lit(False))
    if fill:
        return F.coalesce(v, _number(0, narrow)), F.when(value.isNull(), F.lit(None).cast("string")).when(~fits, fault).when(inexact, "scale")
    return v, F.when(value.isNull(), "null_value").when(~fits, fault).when(inexact, "scale")


def _shown(v: Column, digits: int) -> Column:
    return F.lpad(F.abs(v).cast("string"), digits, "0")


def zoned(value: Column, kind, digits: int, scale: int, signed: bool, sign: tuple[str, bool] | None, encoding: Encoding, fill: bool) -> tuple[Piece, Column]:
    most = 10**digits - 1
    v, wrong = _whole(value, kind, digits, scale, -most if signed else 0, most, "zoned_range", fill)
    shown = _shown(v, digits)
    leading, separate = sign or ("trailing", False)
    plain = "".join(chr(encoding.chars.byte(c)) for c in "0123456789")
    text = lambda t: F.translate(t, "0123456789", plain) if plain != "0123456789" else t
    if not signed:
        return Piece(F.encode(text(shown), "ISO-8859-1"), False), wrong
    if separate:
        mark = F.when(v < 0, chr(encoding.chars.byte("-"))).otherwise(chr(encoding.chars.byte("+")))
        full = F.concat(mark, text(shown)) if leading == "leading" else F.concat(text(shown), mark)
    else:
        own = {k: "".join(map(chr, SIGN_TABLES[encoding.sign][k])) for k in ("negative", "positive")}
        over = lambda t: F.when(v < 0, F.translate(t, "0123456789", own["negative"])).otherwise(F.translate(t, "0123456789", own["positive"]))
        full = F.concat(over(F.substring(shown, 1, 1)), text(F.substring(shown, 2, digits))) if leading == "leading" else F.concat(text(F.substring(shown, 1, digits - 1)), over(F.substring(shown, digits, 1)))
    return Piece(F.encode(full, "ISO-8859-1"), False), wrong


def packed(value: Column, kind, digits: int, scale: int, signed: bool, signless: bool, fill: bool) -> tuple[Piece, Column]:
    most = 10**digits - 1
    v, wrong = _whole(value, kind, digits, scale, -most if signed and not signless else 0, most, "packed_range", fill)
    if signless:
        return Piece(_shown(v, 2 * ((digits + 1) // 2))), wrong
    mark = F.when(v < 0, "D").otherwise("C") if signed else F.lit("F")
    return Piece(F.concat(_shown(v, 2 * (digits // 2) + 1), mark)), wrong


def reversed_pairs(h: Column, width: int) -> Column:
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))]) if width > 1 else h


def binary(value: Column, kind, width: int, digits: int, scale: int, signed: bool, encoding: Encoding, standard: bool, fill: bool) -> tuple[Piece, Column]:
    bits = 8 * width
    if standard:
        most = 10**digits - 1
        least = -most if signed else 0
    else:
        least, most = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if signed else (0, (1 << bits) - 1)
    end = 10**38 - 1
    least, most = max(least, -end), min(most, end)
    # 8 bytes without a sign hold more than a long does
    room = 38 if width == 16 else digits if standard or width < 8 or signed or isinstance(kind, T.IntegralType) else 19
    most = min(most, (1 << 63) - 1) if room <= 18 else most
    v, wrong = _whole(value, kind, room, scale, least, most, "binary_range", fill)
    if room <= 18:
        h = F.lpad(F.hex(v if width >= 8 else v.bitwiseAND(F.lit((1 << bits) - 1))), 2 * width, "0")
    elif width <= 8:
        low = F.when(v >= _number(1 << 63, False), v - _number(1 << 64, False)).otherwise(v)
        h = F.lpad(F.hex(low.try_cast("long")), 16, "0")
    else:
        step = F.lit(str(1 << 64)).cast("decimal(20,0)")
        low = F.pmod(v, step.cast(WIDE))
        high = ((v - low) / step).cast(WIDE)
        part = lambda x: F.lpad(F.hex(F.when(x >= _number(1 << 63, False), x - _number(1 << 64, False)).otherwise(x).cast("long")), 16, "0")
        h = F.concat(part(high), part(low))
    return Piece(reversed_pairs(h, width) if encoding.byte_order == "little" else h), wrong


def floating(value: Column, double: bool, encoding: Encoding, fill: bool) -> tuple[Piece, Column]:
    """COMP-1 and COMP-2 from the bits of the JVM's float or double, which a Java method gives."""
    x, width = F.coalesce(value.cast("double"), F.lit(0.0)), 8 if double else 4
    null = F.when(value.isNull(), "null_value") if not fill else F.when(F.lit(False), "")
    if encoding.float_format == "ieee":
        java = ("java.lang.Double", "doubleToRawLongBits", x) if double else ("java.lang.Float", "floatToRawIntBits", x.cast("float"))
        bits = F.java_method(F.lit(java[0]), F.lit(java[1]), java[2]).cast("long")
        h = F.lpad(F.hex(bits if double else bits.bitwiseAND(F.lit(0xFFFFFFFF))), 2 * width, "0")
        over = F.lit(False) if double else (F.abs(x.cast("float").cast("double")) == float("inf")) & (F.abs(x) != float("inf"))
        return Piece(reversed_pairs(h, width) if encoding.byte_order == "little" else h), null.when(over, "float_range")
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x).cast("long")
    size = 56 if double else 24

    def fraction_of(b: Column) -> tuple[Column, Column]:
        """The characteristic and fraction of a hexadecimal float, from a double's bits."""
        whole = b.bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(1 << 52)  # 53 bits, the value is whole / 2**53 * 2**power
        power = F.shiftright(b, 52).bitwiseAND(F.lit(0x7FF).cast("long")) - 1022
        hexes = F.shiftright(power + 3, 2)
        shift = 4 * hexes - power  # 0 to 3
        by = lambda make: F.when(shift == 0, make(0)).when(shift == 1, make(1)).when(shift == 2, make(2)).otherwise(make(3))
        if double:
            return hexes + 64, by(lambda s: F.shiftleft(whole, 3 - s))
        near = by(lambda s: F.shiftright(whole + F.lit(1 << (28 + s)), 29 + s))
        return hexes + 64 + F.shiftright(near, 24), F.when(F.shiftright(near, 24) > 0, F.shiftright(near, 4)).otherwise(near)

    def shown(b: Column) -> Column:
        characteristic, fraction = fraction_of(b)
        top = F.when(b < 0, characteristic + 128).otherwise(characteristic).bitwiseAND(F.lit(255).cast("long"))
        return F.when(x == 0, F.lit("0" * (2 * width))).otherwise(F.concat(F.lpad(F.hex(top), 2, "0"), F.lpad(F.hex(fraction), size // 4, "0")))

    def outside(b: Column) -> Column:
        return (x != 0) & ~fraction_of(b)[0].between(0, 127) | (F.shiftright(b, 52).bitwiseAND(F.lit(0x7FF).cast("long")) == 0x7FF)

    once = lambda make: F.get(F.transform(F.array(bits), make), F.lit(0))  # noqa: E731  the bits are had once, not wherever they are used
    return Piece(once(shown)), null.when(once(outside), "float_range")
