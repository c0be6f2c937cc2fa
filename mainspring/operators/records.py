"""Decoding and encoding of records: one select of independent expressions per layout."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from .. import errors
from ..functions import decode, encode, picture
from ..functions.encoding import ENCODINGS, Encoding
from ..plans import copybook
from ..plans.layout import DIALECTS, Dialect, Item, Layout, lay_out

MODES = ("FAILFAST", "PERMISSIVE", "DROPMALFORMED")
FAULTS = "array<struct<field: string, offset: int, kind: string, byte: string>>"


@dataclass(frozen=True)
class RecordFormat:
    """All facts about a record file: layout, dialect and encoding, and how COMP truncates."""

    layout: Layout
    encoding: Encoding
    trunc: str
    keep_filler: bool = False
    integral: bool = False

    @staticmethod
    def of(source: str, dialect: str | Dialect, encoding: str | Encoding, trunc: str, record: str | None = None, fixed: bool = False, resolver=None, decimal_comma: bool = False, keep_filler: bool = False, integral: bool = False) -> RecordFormat:
        """From copybook text; dialect, encoding and trunc (std or bin) are stated, never guessed.

        integral decodes whole numbers of up to 9 digits to int and of up to 18 to long.
        """
        dialect = DIALECTS[dialect] if isinstance(dialect, str) else dialect
        encoding = (ENCODINGS[encoding] if isinstance(encoding, str) else encoding).validate()
        if dialect.validate().binary != encoding.binary:
            raise errors.EncodingError(f"binary sizes differ: dialect {dialect.binary}, encoding {encoding.binary}")
        if trunc not in ("std", "bin"):
            raise errors.EncodingError(f"trunc {trunc!r} is neither std nor bin")
        found = copybook.records(source, fixed, resolver, decimal_comma)
        own = [r for r in found if record is None or copybook.same_name(r.name, record)]
        if not own:
            raise errors.LevelError(f"no record {record or ''}")
        return RecordFormat(lay_out(own[0], dialect), encoding, trunc, keep_filler, integral)


def column_name(item: Item) -> str:
    return item.name or "FILLER"


def _shown(item: Item, keep: bool) -> bool:
    return keep or not item.field.filler


class _Decoder:
    """Columns of a layout over a record column.

    prepare() adds projections with the counts of DEPENDING ON tables and the staged bytes of
    all items outside tables, so each is computed once however often it is used; what is not
    used is pruned.
    """

    def __init__(self, fmt: RecordFormat, record: Column, fail: bool = False) -> None:
        self.fmt, self.record, self.fail, self.counts, self.staged = fmt, record, fail, {}, {}

    def count(self, table: Item) -> Column:
        """Occurrences of a table in this record; a count that is faulty or out of bounds is null, or an error."""
        if table not in self.counts:
            value, _ = self._count(table.control)
            good = F.when(value.between(table.min_occurs, table.max_occurs), value.cast("int"))
            if self.fail:
                at, width = table.control.at.column(self.count), table.control.length_.args[0]
                message = F.concat(F.lit(f"{column_name(table.control)}: no count of {table.min_occurs} to {table.max_occurs} {column_name(table)} at offset "), at.cast("string"), F.lit(": "), F.hex(decode.cut(self.record, at, width)))
                good = good.otherwise(F.raise_error(message).cast("int"))
            self.counts[table] = good
        return self.counts[table]

    def _count(self, item: Item) -> tuple[Column, Column]:
        """A count and its fault. Zoned digits are read whatever the charset, and else by the file's own signs."""
        at, p, record, width = item.at.column(self.count), item.field.picture, self.record, item.length_.args[0]
        whole = F.length(record) >= at + width
        h = F.hex(decode.cut(record, at, width))
        if item.field.usage == "comp-3":
            value, wrong, ok = decode.packed(h, at, p.digits, 0)
            last = F.substring(h, -2, 2)
            negative = F.substring(last, 2, 1).isin("B", "D")
            return F.when(whole & ok & ~negative, value), F.coalesce(wrong, F.when(negative, decode.fault(at + p.digits // 2, "occurs_count", last)))
        if item.field.usage == "comp-6":
            value, wrong, ok = decode.packed(h, at, p.digits, 0, True)
            return F.when(whole & ok, value), wrong
        if item.field.usage != "display":
            value, wrong, ok = self._read(item, at)
            return F.when(whole & ok, value), wrong
        sign = item.sign() or ("trailing", False)
        n = p.digits
        zone, signed = "[3F][0-9]", "[34CF][0-9]" if p.signed else "[3F][0-9]"
        if p.signed and sign[1]:
            shape = "(?:2B|4E)" + f"(?:{zone}){{{n}}}" if sign[0] == "leading" else f"(?:{zone}){{{n}}}" + "(?:2B|4E)"
            body = F.substring(h, 3, 2 * n) if sign[0] == "leading" else F.substring(h, 1, 2 * n)
        else:
            body, shape = h, (signed + f"(?:{zone}){{{n - 1}}}" if sign[0] == "leading" else f"(?:{zone}){{{n - 1}}}" + signed)
        alike = F.when(h.rlike(f"^{shape}$"), F.regexp_replace(body, "(.)(.)", "$2").try_cast("decimal(31,0)"))
        declared, _, ok = self._read(item, at)
        value = F.when(whole, F.coalesce(alike, F.when(ok & (declared >= 0), declared.cast("decimal(31,0)"))))
        return value, F.when(value.isNull(), decode.fault(at, "occurs_count", F.substring(h, 1, 2)))

    def stage(self, item: Item, at: Column) -> Column:
        """The bytes of an elementary item in the form that its decoder takes."""
        f, p, width = item.field, item.field.picture, item.length_.args[0]
        own = decode.cut(self.record, at, width)
        if f.usage in ("index", "pointer"):
            return own
        if f.usage in ("comp-1", "comp-2"):
            return decode.stage_number(own, width, True, self.fmt.encoding, self.fmt.encoding.float_format == "ieee").cast("long")
        if f.usage == "display":
            return decode.latin(own)
        if f.usage in ("comp-3", "comp-6"):
            return F.hex(own)
        return decode.stage_number(own, width, p.signed, self.fmt.encoding)

    def _read(self, item: Item, at: Column, staged: Column | None = None) -> tuple[Column, Column, Column]:
        f, p, enc, width = item.field, item.field.picture, self.fmt.encoding, item.length_.args[0]
        own = self.stage(item, at) if staged is None else staged
        first = F.hex(decode.cut(self.record, at, 1))
        if f.usage in ("index", "pointer"):
            return own, F.lit(None).cast(decode.FAULT), F.lit(True)
        if f.usage in ("comp-1", "comp-2"):
            return decode.floating(own, at, f.usage == "comp-2", enc, first)
        if p.category != picture.NUMERIC:
            return decode.alphanumeric(own, enc, f.entry.justified), F.lit(None).cast(decode.FAULT), F.lit(True)
        if f.usage == "display":
            return decode.zoned(own, at, p.digits, p.scale, p.signed, item.sign(), enc)
        if f.usage in ("comp-3", "comp-6"):
            return decode.packed(own, at, p.digits, p.scale, f.usage == "comp-6")
        return decode.binary(own, at, width, p.digits, p.scale, f.usage == "binary" and self.fmt.trunc == "std", first)

    def prepare(self, df: DataFrame) -> DataFrame:
        for k, table in enumerate(self.fmt.layout.tables):
            count = self.count(table)
            df = df.withColumn(f"__count_{k}", count)
            self.counts[table] = F.col(f"__count_{k}")
        staged = {}
        for k, item in enumerate(self.fmt.layout.items()):
            up, table = item, False
            while up is not None:
                table, up = table or up.is_table, up.parent
            if not table and not item.field.is_group:
                staged[f"__raw_{k}"] = self.stage(item, item.at.column(self.count))
                self.staged[item] = F.col(f"__raw_{k}")
        return df.withColumns(staged) if staged else df

    def steps(self, table: Item) -> Column:
        """The numbers from zero of a table's occurrences in this record, as an array."""
        if table.control is None:
            return F.sequence(F.lit(0), F.lit(table.max_occurs - 1))
        count = self.count(table)  # null where the record has no usable one, and so is the array
        return F.when(count > 0, F.sequence(F.lit(0), count - 1)).when(count == 0, F.array().cast("array<int>"))

    def value(self, item: Item, shift: Column) -> Column:
        if item.is_table:
            stride = item.stride_.column(self.count)
            if item.control is None and item.max_occurs <= 4 and not item.field.is_group:
                return F.array(*[self._one(item, shift + stride * k) for k in range(item.max_occurs)])
            return F.transform(self.steps(item), lambda i: self._one(item, shift + stride * i))
        return self._one(item, shift)

    def _one(self, item: Item, shift: Column) -> Column:
        if item.field.is_group:
            own = [c for c in item.children if _shown(c, self.fmt.keep_filler)]
            return F.struct(*[self.value(c, shift).alias(column_name(c)) for c in own]) if own else F.lit(None).cast("string")
        at = item.at.column(self.count) + shift
        value, _, ok = self._read(item, at, self.staged.get(item))
        value = value.cast(decode_type(item, self.fmt)) if self.fmt.integral else value
        good = F.when((F.length(self.record) >= at + item.length_.args[0]) & ok, value)
        if not self.fail:
            return good
        message = F.concat(F.lit(f"{column_name(item)}: invalid at offset "), at.cast("string"), F.lit(": "), F.hex(decode.cut(self.record, at, item.length_.args[0])))
        return good.otherwise(F.raise_error(message).cast(decode_type(item, self.fmt)))

    def faults(self, item: Item, shift: Column) -> list[Column]:
        """Arrays of faults of the item and those below it, in order of the layout."""
        if item.is_table:
            stride = item.stride_.column(self.count)
            every = F.flatten(F.transform(self.steps(item), lambda i: F.concat(*self._faults_once(item, shift + stride * i))))
            return [F.coalesce(every, F.array().cast(FAULTS))]
        return self._faults_once(item, shift)

    def sound(self, item: Item, shift: Column) -> list[Column]:
        """Tests that together say whether the item and those below it have no fault; null counts as a fault."""
        if item.is_table:
            stride = item.stride_.column(self.count)
            return [F.forall(self.steps(item), lambda i: _all(self._sound_once(item, shift + stride * i)))]
        return self._sound_once(item, shift)

    def _sound_once(self, item: Item, shift: Column) -> list[Column]:
        if item.field.is_group:
            return [x for c in item.children if c.redefines is None for x in self.sound(c, shift)]
        at = item.at.column(self.count) + shift
        out = [F.length(self.record) >= at + item.length_.args[0]] if self.fmt.layout.variable else []
        out.append(self._read(item, at, self.staged.get(item))[2])
        for t in self.fmt.layout.tables:
            if t.control is item:
                out.append(self.count(t).isNotNull())
        return out

    def _faults_once(self, item: Item, shift: Column) -> list[Column]:
        if item.field.is_group:
            own = [c for c in item.children if c.redefines is None]  # one view of overlaid bytes is judged
            return [x for c in own for x in self.faults(c, shift)] or [F.array().cast(FAULTS)]
        at, width = item.at.column(self.count) + shift, item.length_.args[0]
        _, wrong, _ = self._read(item, at, self.staged.get(item))
        short = F.length(self.record) < at + width
        end = F.length(self.record)
        if any(t.control is item for t in self.fmt.layout.tables):
            table = next(t for t in self.fmt.layout.tables if t.control is item)
            value, bad = self._count(item)
            out = (value < table.min_occurs) | (value > table.max_occurs)
            wrong = F.coalesce(wrong, bad, F.when(out, decode.fault(at, "occurs_count", F.hex(decode.cut(self.record, at, 1)))))
        both = F.when(short, decode.fault(end, "short_record", F.lit(None).cast("string"))).when(at.isNotNull(), wrong)
        named = F.struct(F.lit(column_name(item)).alias("field"), both["offset"].alias("offset"), both["kind"].alias("kind"), both["byte"].alias("byte"))
        return [F.when(both.isNull(), F.array().cast(FAULTS)).otherwise(F.array(named))]


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _sound(d: _Decoder) -> Column:
    """Whether a record has no fault at all, in one pass of short tests."""
    layout = d.fmt.layout
    whole = [] if layout.variable else [F.length(d.record) >= layout.length]
    return F.coalesce(_all(whole + d.sound(layout.root, F.lit(0))), F.lit(False))


def fault_column(fmt: RecordFormat, record: Column) -> Column:
    """All faults of a record, in order of the layout."""
    return _faults_of(_Decoder(fmt, record))


def _faults_of(d: _Decoder) -> Column:
    """The faults in order of the layout; they are only looked for where the short tests fail."""
    return F.when(_sound(d), F.array().cast(FAULTS)).otherwise(F.concat(*d.faults(d.fmt.layout.root, F.lit(0))).cast(FAULTS))


def decode_type(item: Item, fmt: RecordFormat) -> str:
    """The Spark type of an elementary item, as DDL."""
    f, p = item.field, item.field.picture
    if f.usage in ("index", "pointer"):
        return "binary"
    if f.usage in ("comp-1", "comp-2"):
        return "float" if f.usage == "comp-1" else "double"
    if p.category != picture.NUMERIC:
        return "string"
    width = item.length_.args[0]
    if f.usage == "comp-5" or f.usage == "binary" and fmt.trunc == "bin":
        return "decimal(38,%d)" % max(0, p.scale) if p.scale else {1: "int", 2: "int", 4: "long"}.get(width, "decimal(20,0)" if width <= 8 else "decimal(38,0)")
    if fmt.integral and p.scale == 0 and p.digits <= 18:
        return "int" if p.digits <= 9 else "long"
    return decode.decimal_type(p.digits, p.scale).simpleString()


def decode_columns(fmt: RecordFormat, record: Column, fail: bool = False) -> list[Column]:
    """A column for each item of the record's top level, or one for an elementary record."""
    return _values_of(_Decoder(fmt, record, fail))


def _values_of(d: _Decoder) -> list[Column]:
    fmt, root = d.fmt, d.fmt.layout.root
    items = [c for c in root.children if _shown(c, fmt.keep_filler)] if root.field.is_group and not root.is_table else [root]
    return [d.value(i, F.lit(0)).alias(column_name(i)) for i in items]


def condition_columns(d: _Decoder) -> list[Column]:
    """A boolean column for each level 88: whether any of its values or ranges holds.

    Inside tables it is an array, nested as the tables are. Numbers are compared as numbers;
    text, and groups as a whole, by the bytes of the file's charset, the shorter side padded
    with spaces. A faulty or missing item gives null.
    """
    out = []
    for item in d.fmt.layout.items():
        tables, up = [], item
        while up is not None:
            tables, up = ([up, *tables] if up.is_table else tables), up.parent
        for c in item.field.conditions:
            out.append(_over(d, tables, F.lit(0), lambda shift, item=item, c=c: _holds(d, item, shift, c.values)).alias(c.name))
    return out


def _over(d: _Decoder, tables: list[Item], shift: Column, make) -> Column:
    """make(shift) for every occurrence of the tables, outermost first, as nested arrays."""
    if not tables:
        return make(shift)
    stride = tables[0].stride_.column(d.count)
    return F.transform(d.steps(tables[0]), lambda i: _over(d, tables[1:], shift + stride * i, make))


def _holds(d: _Decoder, item: Item, shift: Column, values: list[tuple[str, str | None]]) -> Column:
    p, usage = item.field.picture, item.field.usage
    if not item.field.is_group and (usage in ("comp-1", "comp-2") or p is not None and p.category == picture.NUMERIC):
        own = d._one(item, shift)
        ends = [(number(a), number(b or a)) for a, b in values]
        tests = [F.lit(False) if x is None or y is None else own.between(x, y) for x, y in ends]
    else:
        at, width = item.at.column(d.count) + shift, item.length_.column(d.count)
        own = F.when(F.length(d.record) >= at + width, decode.latin(decode.cut(d.record, at, width)))
        space = d.fmt.encoding.chars.unicode.index(" ")

        def against(text: str, test) -> Column:
            text, size = characters(text, d.fmt.encoding)
            n = width if size is None else F.greatest(width, F.lit(size))
            fill = chr(space) if size is not None else text or chr(space)
            return test(F.rpad(own, n, chr(space)), F.rpad(F.lit(text), n, fill))

        tests = [against(a, lambda x, y: x == y) if b is None else against(a, lambda x, y: x >= y) & against(b, lambda x, y: x <= y) for a, b in values]
    test = tests[0]
    for t in tests[1:]:
        test = test | t
    return test


#: Figurative constants and the byte or character that each repeats.
FIGURATIVE = {"SPACE": " ", "SPACES": " ", "ZERO": "0", "ZEROS": "0", "ZEROES": "0", "QUOTE": '"', "QUOTES": '"', "LOW-VALUE": 0, "LOW-VALUES": 0, "HIGH-VALUE": 255, "HIGH-VALUES": 255}


def number(text: str) -> Column | None:
    """A numeric literal or ZERO as a column; None for any other literal."""
    if FIGURATIVE.get(text.upper()) == "0":
        return F.lit(0)
    return F.lit(text).cast("decimal(38,10)") if re.fullmatch(r"[+-]?[0-9]*\.?[0-9]+", text) else None


def characters(text: str, encoding: Encoding) -> tuple[str, int | None]:
    """The bytes of a literal as Latin-1 characters, and its length; None if it repeats to any length."""
    own, every = FIGURATIVE.get(text.upper()), text[:4].upper() == "ALL "
    if isinstance(own, int):
        return chr(own), None
    if own is None:
        own = text[4:].strip() if every else text
        own = FIGURATIVE.get(own.upper(), own)
        own = chr(own) if isinstance(own, int) else own[1:-1].replace(own[0] * 2, own[0]) if own[:1] in ("\"", "'") and len(own) > 1 else own
        if not every:
            own = own.rstrip(" ")
    else:
        every = True
    known = encoding.chars.unicode
    return "".join(chr(known.index(c)) for c in own if c in known), None if every else len(own)


def alias_columns(d: _Decoder) -> list[Column]:
    """Raw bytes of each level 66 item."""
    fmt, record, out = d.fmt, d.record, []
    by_field = {id(i.field): i for i in fmt.layout.items()}
    for a in fmt.layout.root.field.aliases:
        first, last = by_field[id(a.fields[0])], by_field[id(a.fields[-1])]
        start, end = first.at.column(d.count), last.at.column(d.count) + last.total_.column(d.count)
        out.append(decode.cut(record, start, end - start).alias(a.name))
    return out


def decode_records(df: DataFrame, fmt: RecordFormat, column: str = "value", mode: str = "FAILFAST", keep: tuple[str, ...] = (), conditions: bool = False, aliases: bool = False) -> DataFrame:
    """Records in a binary column to typed columns.

    FAILFAST raises at a fault of an item that the query reads, with its name, offset and
    bytes; what is pruned is not judged. PERMISSIVE gives null for faulty items and lists all
    faults of the record in `_faults`. DROPMALFORMED leaves out records with any fault. `keep`
    names other columns to carry along.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    d = _Decoder(fmt, F.col(column), mode == "FAILFAST")
    df = d.prepare(df)
    own = _values_of(d) + (condition_columns(d) if conditions else []) + (alias_columns(d) if aliases else [])
    if mode == "PERMISSIVE":
        own.append(_faults_of(d).alias("_faults"))
    if mode == "DROPMALFORMED":
        df = df.where(_sound(d))
    return df.select(*keep, *own)


ENCODE_MODES = ("FAILFAST", "PERMISSIVE")
ENCODE_FAULTS = "array<struct<field: string, kind: string>>"
NULLS = ("fail", "fill")


class _Encoder:
    """Bytes and faults of items. `roots` has a column for each item of the record's top level."""

    def __init__(self, fmt: RecordFormat, roots: dict[str, Column], types: dict[str, DataType], fail: bool, nulls: str) -> None:
        if nulls not in NULLS:
            raise ValueError(f"nulls {nulls!r} is none of {', '.join(NULLS)}")
        self.fmt, self.roots, self.types, self.fail, self.fill = fmt, roots, types, fail, nulls == "fill"

    def _demand(self, item: Item, piece: encode.Piece, wrong: Column) -> encode.Piece:
        """The piece where nothing is wrong; else an error, or null if faults are listed instead."""
        good = F.when(wrong.isNull(), piece.column)
        if self.fail:
            said = F.create_map(*[F.lit(x) for k, m in encode.MESSAGES.items() for x in (k, f"{column_name(item)}: {m}")])
            good = good.otherwise(F.raise_error(F.element_at(said, wrong)).cast("string" if piece.is_hex else "binary"))
        return encode.Piece(good, piece.is_hex)

    def _elementary(self, item: Item, value: Column | None, kind: DataType | None) -> tuple[encode.Piece, Column]:
        f, enc, fill = item.field, self.fmt.encoding, self.fill
        width, p = item.length_.args[0], f.picture
        if f.usage in ("index", "pointer"):
            own = F.lit(bytearray(width)) if value is None else F.coalesce(value, F.lit(bytearray(width))) if fill else value
            wrong = F.when(own.isNull(), "null_value").when(F.length(own) != width, "field_too_long")
            return encode.Piece(own, False), wrong
        if value is None:  # an item of no column is zero or spaces
            text = p is not None and p.category != picture.NUMERIC and f.usage not in ("comp-1", "comp-2")
            value, kind, fill = (F.lit(""), StringType(), True) if text else (F.lit(0), IntegerType(), True)
        if f.usage in ("comp-1", "comp-2"):
            return encode.floating(value, f.usage == "comp-2", enc, fill)
        if p.category != picture.NUMERIC:
            return encode.alphanumeric(value, width, enc, f.entry.justified, fill)
        if f.usage == "display":
            return encode.zoned(value, kind, p.digits, p.scale, p.signed, item.sign(), enc, fill)
        if f.usage in ("comp-3", "comp-6"):
            return encode.packed(value, kind, p.digits, p.scale, p.signed, f.usage == "comp-6", fill)
        return encode.binary(value, kind, width, p.digits, p.scale, p.signed, enc, f.usage == "binary" and self.fmt.trunc == "std", fill)

    def _parts(self, group: Item, value, kind) -> list[tuple[Item, Column | None, DataType | None]]:
        """The items of a group that are written, with their values; `value` may be a dict of columns."""
        out = []
        for c in group.children:
            if c.redefines is not None:
                continue
            own, name, sub = None, column_name(c), None
            if isinstance(value, dict):
                own, sub = value.get(name), kind.get(name)
            elif value is not None and _shown(c, self.fmt.keep_filler):
                known = {f.name.upper(): f for f in kind.fields} if isinstance(kind, StructType) else None
                if known is None or name.upper() in known:
                    own, sub = value[name], known[name.upper()].dataType if known else None
            out.append((c, own, sub))
        return out

    def pieces(self, item: Item, value: Column | None, kind: DataType | None) -> list[encode.Piece]:
        """All occurrences of an item; a table takes an array."""
        most = lambda t: t.max_occurs
        if not item.is_table:
            return self._once(item, value, kind)
        gap = item.stride_.value(most) - item.length_.value(most)
        sub = kind.elementType if isinstance(kind, ArrayType) else None
        one = lambda x: F.concat(*[p.hex() for p in self._once(item, x, sub)], F.lit("00" * gap))
        if value is None:
            return [encode.Piece(F.repeat(one(None), item.max_occurs if item.control is None else 0))]
        own = F.coalesce(value, F.array())
        if item.control is None and item.max_occurs <= 8 and not item.field.is_group:
            every = [F.when(F.size(own) > k, one(F.get(own, F.lit(k)))).otherwise(one(None)) for k in range(item.max_occurs)]
            full = F.concat(*every)
        else:
            full = F.array_join(F.transform(own, one), "")
            if item.control is None:  # missing elements at the end are zero or spaces
                full = F.concat(full, F.repeat(one(None), F.greatest(F.lit(0), F.lit(item.max_occurs) - F.size(own))))
        return [self._demand(item, encode.Piece(full), self._count_fault(item, value))]

    def _count_fault(self, item: Item, value: Column) -> Column:
        """A table's array must not have more elements than the table; with DEPENDING ON, as many as its count says."""
        size = F.size(F.coalesce(value, F.array()))
        null = F.when(F.lit(False) if self.fill else value.isNull(), "null_value")
        if item.control is None:
            return null.when(size > item.max_occurs, "occurs_count")
        said = self._control(item.control)
        same = F.coalesce((said == size) & size.between(item.min_occurs, item.max_occurs), F.lit(False))
        return null.when(~same, "occurs_count")

    def _control(self, item: Item) -> Column:
        """The value given for a controlling item; in a table, that of its first occurrence, which readers look at."""
        path, up = [item], item.parent
        while up is not None:
            path, up = [up, *path], up.parent
        path = path[1:] if len(path) > 1 else path
        own, kind = self.roots.get(column_name(path[0])), self.types.get(column_name(path[0]))
        for k, step in enumerate(path):
            if k and own is not None:
                known = {f.name.upper(): f for f in kind.fields} if isinstance(kind, StructType) else None
                here = known is None or column_name(step).upper() in known
                own, kind = (own[column_name(step)], known[column_name(step).upper()].dataType if known else None) if here else (None, None)
            if own is not None and step.is_table:
                own, kind = F.get(own, F.lit(0)), kind.elementType if isinstance(kind, ArrayType) else None
        return F.lit(0) if own is None else F.coalesce(own, F.lit(0)) if self.fill else own

    def _once(self, item: Item, value, kind) -> list[encode.Piece]:
        if not item.field.is_group:
            piece, wrong = self._elementary(item, value, kind)
            return [self._demand(item, piece, wrong)]
        out = []
        for c, own, sub in self._parts(item, value, kind):
            slack = c.slack_.value(lambda t: t.max_occurs)
            out += [encode.constant(bytes(slack))] if slack else []
            out += self.pieces(c, own, sub)
        return out

    def faults(self, item: Item, value, kind) -> list[Column]:
        """Arrays of the faults of an item's values and of those below it, in order of the layout."""
        if item.is_table and value is not None:
            sub = kind.elementType if isinstance(kind, ArrayType) else None
            every = F.flatten(F.transform(F.coalesce(value, F.array()), lambda x: F.concat(*self._faults_once(item, x, sub))))
            return [self._listed(item, self._count_fault(item, value)), every]
        return self._faults_once(item, value, kind)

    def _faults_once(self, item: Item, value, kind) -> list[Column]:
        if item.field.is_group:
            return [x for c, own, sub in self._parts(item, value, kind) if own is not None for x in self.faults(c, own, sub)] or [F.array().cast(ENCODE_FAULTS)]
        return [self._listed(item, self._elementary(item, value, kind)[1])] if value is not None else [F.array().cast(ENCODE_FAULTS)]

    def _listed(self, item: Item, wrong: Column) -> Column:
        return F.when(wrong.isNull(), F.array().cast(ENCODE_FAULTS)).otherwise(F.array(F.struct(F.lit(column_name(item)).alias("field"), wrong.alias("kind"))))


def _encoder(fmt: RecordFormat, columns: dict[str, Column], types: dict[str, DataType] | None, fail: bool, nulls: str) -> tuple[_Encoder, tuple]:
    root, types = fmt.layout.root, types or {}
    e = _Encoder(fmt, columns, types, fail, nulls)
    if root.field.is_group and not root.is_table:
        return e, (root, columns, types)
    return e, (root, columns[column_name(root)], types.get(column_name(root)))


def encode_column(fmt: RecordFormat, columns: dict[str, Column], types: dict[str, DataType] | None = None, fail: bool = True, nulls: str = "fail") -> Column:
    """Record bytes from a column per item of the record's top level.

    Redefining items are left out: bytes are written through the item redefined. Items of no
    column are written as zero or spaces, and so are the elements that an array lacks to fill a
    fixed table. Known types of columns make shorter expressions. What does not fit is an error,
    or with `fail` false gives null.
    """
    e, own = _encoder(fmt, columns, types, fail, nulls)
    return encode.joined(e.pieces(*own))


def encode_records(df: DataFrame, fmt: RecordFormat, keep: tuple[str, ...] = (), column: str = "value", mode: str = "FAILFAST", nulls: str = "fail") -> DataFrame:
    """Rows to records: columns are matched to the record's items by name.

    FAILFAST raises at a value that does not fit: a number of too many digits or decimals, a
    text too long or outside the charset, an array longer than its table or of another length
    than its DEPENDING ON count, a null. PERMISSIVE writes a null record for such a row and
    lists the field and kind of every fault in `_faults`. With nulls="fill" null numbers are
    written as zero, null texts as spaces and null arrays as empty ones instead.
    """
    if mode not in ENCODE_MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(ENCODE_MODES)}")
    names = {n.upper(): n for n in df.columns}
    top = [c for c in (fmt.layout.root.children or [fmt.layout.root]) if column_name(c).upper() in names]
    columns = {column_name(c): F.col(f"`{names[column_name(c).upper()]}`") for c in top}
    types = {column_name(c): df.schema[names[column_name(c).upper()]].dataType for c in top}
    own = encode_column(fmt, columns, types, mode == "FAILFAST", nulls).alias(column)
    if mode == "FAILFAST":
        return df.select(*keep, own)
    e, at = _encoder(fmt, columns, types, False, nulls)
    faults = F.concat(*e.faults(*at)).cast(ENCODE_FAULTS)
    return df.select(*keep, F.when(F.size(faults) == 0, own).alias(column), faults.alias("_faults"))
