"""What a file's bytes mean: charset, sign convention, byte order, float format, binary sizes."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import EncodingError

#: The four zoned sign conventions. Bytes for the digits 0 to 9.
SIGN_TABLES = {
    "ebcdic": {"positive": range(0xC0, 0xCA), "negative": range(0xD0, 0xDA), "plain": range(0xF0, 0xFA), "lenient_positive": (0xA0, 0xE0), "lenient_negative": (0xB0,)},
    "zone37": {"positive": range(0x30, 0x3A), "negative": range(0x70, 0x7A), "plain": range(0x30, 0x3A)},
    "translated": {"positive": (0x7B, *range(0x41, 0x4A)), "negative": (0x7D, *range(0x4A, 0x53)), "plain": range(0x30, 0x3A)},
    "realia": {"positive": range(0x30, 0x3A), "negative": range(0x20, 0x2A), "plain": range(0x30, 0x3A)},
}
#: Fixed values: (most digits, bytes) of each binary size; beyond 18 digits all take 16 bytes.
STAIRCASES = {
    "2-4-8": ((4, 2), (9, 4), (18, 8)),
    "1-2-4-8": ((2, 1), (4, 2), (9, 4), (18, 8)),
    "1--8": ((2, 1), (4, 2), (6, 3), (9, 4), (11, 5), (14, 6), (16, 7), (18, 8)),
    "full": ((18, 8),),
}


@dataclass(frozen=True)
class Charset:
    """A bijection of the 256 bytes to characters; `unicode[b]` is the character of byte b."""

    name: str
    unicode: str

    def byte(self, char: str) -> int:
        return self.unicode.index(char)


ASCII = Charset("ascii", bytes(range(256)).decode("latin-1"))
CP037 = Charset("cp037", bytes(range(256)).decode("cp037"))
CHARSETS = {c.name: c for c in (ASCII, CP037)}


def register_charset(name: str, unicode: str) -> Charset:
    """Make a charset of 256 distinct characters known by its name."""
    if len(unicode) != 256 or len(set(unicode)) != 256:
        raise EncodingError(f"charset {name!r} must map 256 bytes to distinct characters")
    CHARSETS[name] = Charset(name, unicode)
    return CHARSETS[name]


@dataclass(frozen=True)
class Encoding:
    """All five facts are stated by the caller; none has a default."""

    charset: str
    sign: str
    byte_order: str
    float_format: str
    binary: str

    def validate(self) -> Encoding:
        known = (("charset", self.charset, CHARSETS), ("sign", self.sign, SIGN_TABLES), ("byte_order", self.byte_order, ("big", "little")), ("float_format", self.float_format, ("ieee", "hfp")), ("binary", self.binary, STAIRCASES))
        for axis, value, allowed in known:
            if value not in allowed:
                raise EncodingError(f"{axis} {value!r} is none of {', '.join(allowed)}")
        return self

    @property
    def chars(self) -> Charset:
        return CHARSETS[self.charset]


IBM_ENTERPRISE = Encoding("cp037", "ebcdic", "big", "hfp", "2-4-8")
MICRO_FOCUS_ASCII = Encoding("ascii", "zone37", "little", "ieee", "2-4-8")
GNUCOBOL_ASCII = Encoding("ascii", "zone37", "big", "ieee", "1-2-4-8")
CONVERTED_FROM_EBCDIC = Encoding("ascii", "translated", "big", "hfp", "2-4-8")
ENCODINGS = {"ibm": IBM_ENTERPRISE, "microfocus": MICRO_FOCUS_ASCII, "gnucobol": GNUCOBOL_ASCII, "converted": CONVERTED_FROM_EBCDIC}


def binary_width(digits: int, staircase: str) -> int:
    return next((w for most, w in STAIRCASES[staircase] if digits <= most), 16)


def sign_readings(sign: str) -> dict[int, tuple[int, bool]]:
    """Byte in the sign position -> digit and whether it is negative, as a reader accepts them."""
    own, out = SIGN_TABLES[sign], {}
    for kind, negative in (("plain", False), ("positive", False), ("negative", True)):
        out |= {b: (d, negative) for d, b in enumerate(own[kind])}
    for kind, negative in (("lenient_positive", False), ("lenient_negative", True)):
        out |= {zone + d: (d, negative) for zone in own.get(kind, ()) for d in range(10)}
    return out
