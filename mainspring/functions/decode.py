"""Record bytes to values, as Spark columns.

A field is read in two steps. `stage_*` turns its bytes into Latin-1 text, hex digits or a
number, which the caller puts into a projection of its own, so that it is computed once. The
builders named after the formats take that and the field's offset, and return the value, the
first fault in field order as a struct (offset, kind, byte), null if there is none, and a
short test that there is none. All is built-in functions: unread fields vanish from the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .encoding import Encoding, sign_readings

FAULT = "struct<offset: int, kind: string, byte: string>"


def char_class(points) -> str:
    return "[" + "".join(f"\\x{{{p:02X}}}" for p in points) + "]"


def latin(field: Column) -> Column:
    return F.decode(field, "ISO-8859-1")


def cut(record: Column, at: Column, width) -> Column:
    return F.substring(record, at + 1, width if isinstance(width, Column) else F.lit(width))


def shaped(text: Column, pattern: str) -> Column:
    return text.rlike(f"^{pattern}$")


def fault(at: Column, kind, byte) -> Column:
    return F.struct(at.cast("int").alias("offset"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), byte.alias("byte"))


def _no_fault() -> Column:
    return F.lit(None).cast(FAULT)


def decimal_type(digits: int, scale: int) -> T.DecimalType:
    """The type of digits and scale; what exceeds 38 digits stays unscaled."""
    if scale < 0:
        p, s = digits - scale, 0
    elif scale > digits:
        p, s = scale, scale
    else:
        p, s = digits, scale
    return T.DecimalType(max(p, 1), s) if p <= 38 else T.DecimalType(digits, 0)


def scaled(text: Column, negative: Column | None, digits: int, scale: int) -> Column:
    """Exactly `digits` decimal digits, with the picture's scale, as a decimal."""
    kind = decimal_type(digits, scale)
    if scale == 0 and digits <= 18:  # a long is parsed in a fraction of a decimal's time
        whole = text.cast("long")
        return (whole if negative is None else F.when(negative, -whole).otherwise(whole)).cast(kind)
    if kind.precision == digits and kind.scale == 0 and scale != 0:
        shown = text
    elif scale < 0:
        shown = F.concat(text, F.lit("0" * -scale))
    elif scale > digits:
        shown = F.concat(F.lit("0." + "0" * (scale - digits)), text)
    elif scale:
        shown = F.concat(F.substring(text, 1, digits - scale), F.lit("."), F.substring(text, digits - scale + 1, scale))
    else:
        shown = text
    if negative is not None:
        shown = F.concat(F.when(negative, "-").otherwise(""), shown)
    return shown.cast(kind)


def alphanumeric(text: Column, encoding: Encoding, right: bool = False) -> Column:
    """Text of a field through the charset, trimmed of pad spaces on the side it was padded on."""
    own = encoding.chars.unicode
    pairs = [(chr(b), c) for b, c in enumerate(own) if b and chr(b) != c]
    if own[0] != "\0":
        text = F.regexp_replace(text, "\\x00", re.escape(own[0]))
    if pairs:
        text = F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.ltrim(text) if right else F.rtrim(text)


def zoned(text: Column, at: Column, digits: int, scale: int, signed: bool, sign: tuple[str, bool] | None, encoding: Encoding) -> tuple[Column, Column, Column]:
    """Zoned decimal; sign is the clause in force (leading or trailing, separate)."""
    leading, separate = (sign or ("trailing", False))
    leading = leading == "leading" if isinstance(leading, str) else leading
    width = digits + (1 if signed and separate else 0)
    plain = [encoding.chars.byte(c) for c in "0123456789"]
    own = "".join(map(chr, plain))
    to_digits = lambda t: t if own == "0123456789" else F.translate(t, own, "0123456789")
    byte = lambda k: F.hex(F.encode(F.substring(text, (k if isinstance(k, Column) else F.lit(k)) + 1, F.lit(1)), "ISO-8859-1"))
    run = lambda t: F.length(F.regexp_extract(t, "^" + char_class(plain) + "*", 0))
    if not signed:
        good = run(text)
        return scaled(to_digits(text), None, digits, scale), F.when(good < digits, fault(at + good, "zoned_digit", byte(good))), shaped(text, f"{char_class(plain)}{{{digits}}}")
    if separate:
        body, mark = (F.substring(text, 2, digits), F.substring(text, 1, 1)) if leading else (F.substring(text, 1, digits), F.substring(text, width, 1))
        plus, minus = (chr(encoding.chars.byte(c)) for c in "+-")
        place, shift, good = (0 if leading else digits), (1 if leading else 0), run(body)
        wrong = F.when(~mark.isin(plus, minus), fault(at + place, "zoned_separate_sign", byte(F.lit(place))))
        signs, row = char_class(map(ord, (plus, minus))), f"{char_class(plain)}{{{digits}}}"
        return scaled(to_digits(body), mark == minus, digits, scale), wrong.when(good < digits, fault(at + shift + good, "zoned_digit", byte(shift + good))), shaped(text, signs + row if leading else row + signs)
    readings = sign_readings(encoding.sign)
    marks = {chr(b): r for b, r in readings.items()}
    body, mark = (F.substring(text, 2, digits - 1), F.substring(text, 1, 1)) if leading else (F.substring(text, 1, digits - 1), F.substring(text, digits, 1))
    digit = F.translate(mark, "".join(marks), "".join(str(d) for d, _ in marks.values()))
    negative = mark.isin(*[c for c, (_, n) in marks.items() if n])
    good, place = run(body), 0 if leading else digits - 1
    bad_sign = ~mark.isin(*marks)
    sign_fault, digit_fault = fault(at + place, "zoned_sign", byte(F.lit(place))), fault(at + good + (1 if leading else 0), "zoned_digit", byte(good + (1 if leading else 0)))
    wrong = F.when(bad_sign, sign_fault).when(good < digits - 1, digit_fault) if leading else F.when(good < digits - 1, digit_fault).when(bad_sign, sign_fault)
    whole = F.concat(digit, to_digits(body)) if leading else F.concat(to_digits(body), digit)
    signs, row = char_class(readings), f"{char_class(plain)}{{{digits - 1}}}"
    return scaled(whole, negative, digits, scale), wrong, shaped(text, signs + row if leading else row + signs)


def packed(h: Column, at: Column, digits: int, scale: int, signless: bool = False) -> tuple[Column, Column, Column]:
    """COMP-3, or COMP-6 without a sign nibble; earliest bad nibble first."""
    width = (digits + 1) // 2 if signless else digits // 2 + 1
    pad = (digits + (0 if signless else 1)) % 2
    body = F.substring(h, pad + 1, digits)
    good = F.length(F.regexp_extract(body, "^[0-9]*", 0))
    byte = lambda k: F.substring(h, 2 * (k if isinstance(k, Column) else F.lit(k)) + 1, F.lit(2))
    place = F.floor((good + pad) / 2).cast("int")
    wrong = F.when(F.lit(bool(pad)) & (F.substring(h, 1, 1) != "0"), fault(at, "packed_pad", byte(F.lit(0)))).when(good < digits, fault(at + place, "packed_digit", byte(place)))
    if signless:
        return scaled(body, None, digits, scale), wrong, shaped(h, "0" * pad + f"[0-9]{{{digits}}}")
    sign = F.substring(h, 2 * width, 1)
    wrong = wrong.when(sign < "A", fault(at + (width - 1), "packed_sign", byte(F.lit(width - 1))))
    return scaled(body, sign.isin("B", "D"), digits, scale), wrong, shaped(h, "0" * pad + f"[0-9]{{{digits}}}[A-F]")


def reverse_pairs(h: Column, width: int) -> Column:
    """Hex digits of `width` bytes in the opposite byte order."""
    return F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(width))])


def stage_number(field: Column, width: int, signed: bool, encoding: Encoding, reverse: bool = True) -> Column:
    """Bytes as a whole number: long if it fits, else a decimal; null where 16 bytes exceed 38 digits."""
    h = F.hex(field)
    if reverse and encoding.byte_order == "little":
        h = reverse_pairs(h, width)
    if width <= 8:
        if not signed:
            return F.conv(h, 16, 10).cast("decimal(20,0)" if width == 8 else "long")
        if width == 8:
            return F.conv(h, 16, -10).cast("long")
        v, half = F.conv(h, 16, 10).cast("long"), 1 << (8 * width - 1)
        return F.pmod(v + half, F.lit(1 << (8 * width))) - half
    high = F.conv(F.substring(h, 1, 16), 16, -10).cast("long")
    low = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    wide, step = "decimal(38,0)", F.lit(1 << 32).cast("decimal(10,0)")
    top = F.when(high.between(-5000000000000000000, 5000000000000000000), high).cast("decimal(19,0)")
    return ((top * step).cast("decimal(29,0)").cast(wide) * step).cast(wide) + low


def binary(v: Column, at: Column, width: int, digits: int, scale: int, standard: bool, first: Column) -> tuple[Column, Column, Column]:
    """COMP or COMP-5 from its staged number; standard means it must fit the picture's digits."""
    if standard or width == 16:
        ok = F.coalesce(F.abs(v.cast("decimal(38,0)")) <= F.lit("9" * (digits if standard else 37)).cast("decimal(38,0)") if width > 8 or digits > 17 else v.between(-(10**digits) + 1, 10**digits - 1), F.lit(False))
        wrong = F.when(~ok, fault(at, "binary_range", first))
    else:
        wrong, ok = _no_fault(), F.lit(True)
    if standard:
        kind = decimal_type(digits, scale)
        return (scaled(F.lpad(F.abs(v).cast("string"), digits, "0"), v < 0, digits, scale) if scale else v.cast(kind)), wrong, ok
    kind = {1: "int", 2: "int", 4: "long"}.get(width)
    if scale:
        unit = F.lit("0." + "0" * (scale - 1) + "1").cast(T.DecimalType(scale + 1, scale)) if scale > 0 else F.lit("1" + "0" * -scale).cast(T.DecimalType(1 - scale, 0))
        return (v.cast("decimal(38,0)") * unit).cast(T.DecimalType(38, max(0, scale))), wrong, ok
    return v.cast(kind or ("decimal(20,0)" if width <= 8 else "decimal(38,0)")), wrong, ok


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def floating(v: Column, at: Column, double: bool, encoding: Encoding, first: Column) -> tuple[Column, Column, Column]:
    """COMP-1 and COMP-2 from their staged bits (a signed number), by exact scaling with powers of two."""
    width = 8 if double else 4
    negative, bits = v < 0, v.bitwiseAND(F.lit((1 << (8 * width - 1)) - 1))
    sign = F.when(negative, -1.0).otherwise(1.0)
    if encoding.float_format == "hfp":
        size = 56 if double else 24
        exponent, fraction = F.shiftright(bits, size).cast("int") - 64, bits.bitwiseAND(F.lit((1 << size) - 1)).cast("double")
        out = F.when(fraction == 0.0, 0.0).otherwise(sign * fraction * _power(4 * exponent - size))
        if double:
            return out, _no_fault(), F.lit(True)
        ok = (bits.bitwiseAND(F.lit((1 << size) - 1)) == 0) | F.abs(out).between(1.401298464324817e-45, 3.4028234663852886e38)
        return out.cast("float"), F.when(~ok, fault(at, "float_range", first)), ok
    exponent_bits, mantissa_bits = (11, 52) if double else (8, 23)
    exponent, mantissa = F.shiftright(bits, mantissa_bits).cast("int"), bits.bitwiseAND(F.lit((1 << mantissa_bits) - 1))
    top, bias = (1 << exponent_bits) - 1, (1 << (exponent_bits - 1)) - 1 + mantissa_bits
    out = F.when(exponent == 0, mantissa.cast("double") * _power(F.lit(1 - bias))).when(exponent < top, (mantissa + F.lit(1 << mantissa_bits)).cast("double") * _power(exponent - bias)).when(mantissa == 0, float("inf")).otherwise(float("nan"))
    return (sign * out if double else (sign * out).cast("float")), _no_fault(), F.lit(True)
