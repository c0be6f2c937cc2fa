"""Record trees to byte layouts with symbolic offsets.

Offsets are small expressions over the occurrence counts of DEPENDING ON tables. The same
expression gives the static layout (counts at their maximum), the layout of one record, and a
Spark column for the offset within each record, so no record is laid out by Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .. import errors
from ..functions import picture
from ..functions.encoding import STAIRCASES, binary_width
from .copybook import Field, same_name


@dataclass(frozen=True)
class Dialect:
    """Compiler facts; none has a default."""

    binary: str
    sync: str  # aligned or ignored
    redefines: str  # strict or lenient
    index_width: int
    pointer_width: int

    def validate(self) -> Dialect:
        if self.binary not in STAIRCASES:
            raise errors.DialectError(f"binary size {self.binary!r}")
        if self.sync not in ("aligned", "ignored"):
            raise errors.DialectError(f"sync {self.sync!r}")
        if self.redefines not in ("strict", "lenient"):
            raise errors.DialectError(f"redefines {self.redefines!r}")
        for width in (self.index_width, self.pointer_width):
            if not 1 <= width <= 16:
                raise errors.DialectError(f"width {width} is not within 1 to 16")
        return self


IBM = Dialect("2-4-8", "aligned", "strict", 4, 4)
GNUCOBOL = Dialect("1-2-4-8", "ignored", "lenient", 4, 8)
MICRO_FOCUS = Dialect("2-4-8", "aligned", "strict", 4, 8)
DIALECTS = {"ibm": IBM, "gnucobol": GNUCOBOL, "microfocus": MICRO_FOCUS}


@dataclass(frozen=True)
class Expr:
    """op is const, count, add, mul, round or max; args are numbers, items or expressions."""

    op: str
    args: tuple

    def __add__(self, other: Expr) -> Expr:
        if self.op == other.op == "const":
            return const(self.args[0] + other.args[0])
        if const(0) in (self, other):
            return other if self == const(0) else self
        return Expr("add", (self, other))

    def __mul__(self, other: Expr) -> Expr:
        if self.op == other.op == "const":
            return const(self.args[0] * other.args[0])
        return self if other == const(1) else other if self == const(1) else Expr("mul", (self, other))

    def up_to(self, boundary: int) -> Expr:
        if boundary == 1:
            return self
        if self.op == "const":
            return const(-(-self.args[0] // boundary) * boundary)
        return Expr("round", (self, boundary))

    def larger(self, other: Expr) -> Expr:
        if self.op == other.op == "const":
            return const(max(self.args[0], other.args[0]))
        return Expr("max", (self, other))

    def value(self, counts: Callable[[Item], int]) -> int:
        a = self.args
        if self.op == "const":
            return a[0]
        if self.op == "count":
            return counts(a[0])
        left = a[0].value(counts)
        if self.op == "round":
            return -(-left // a[1]) * a[1]
        right = a[1].value(counts)
        return left + right if self.op == "add" else left * right if self.op == "mul" else max(left, right)

    def column(self, counts):
        """The expression as a Spark column, given a count column for each table."""
        from pyspark.sql import functions as F

        a = self.args
        if self.op == "const":
            return F.lit(a[0])
        if self.op == "count":
            return counts(a[0])
        left = a[0].column(counts)
        if self.op == "round":
            return left + F.pmod(-left, F.lit(a[1]))
        right = a[1].column(counts)
        return left + right if self.op == "add" else left * right if self.op == "mul" else F.greatest(left, right)


def const(n: int) -> Expr:
    return Expr("const", (n,))


@dataclass(eq=False)
class Item:
    field: Field
    parent: Item | None
    at: Expr
    min_occurs: int
    max_occurs: int
    control: Item | None
    length_: Expr = field(default_factory=lambda: const(0))
    stride_: Expr = field(default_factory=lambda: const(0))
    slack_: Expr = field(default_factory=lambda: const(0))
    children: list[Item] = field(default_factory=list)
    redefines: Item | None = None

    @property
    def name(self) -> str | None:
        return self.field.name

    @property
    def count(self) -> Expr:
        return Expr("count", (self,)) if self.control is not None else const(self.max_occurs)

    @property
    def total_(self) -> Expr:
        return self.stride_ * self.count if self.max_occurs > 1 or self.control is not None else self.length_

    @property
    def is_table(self) -> bool:
        return self.field.entry.occurs is not None

    def separate_sign(self) -> bool:
        sign = self.sign()
        return bool(self.field.picture and self.field.picture.signed and sign and sign[1])

    def sign(self) -> tuple[str, bool] | None:
        """The SIGN clause in force: the nearest enclosing one."""
        f = self.field
        while f is not None:
            if f.entry.sign:
                return f.entry.sign
            f = f.parent
        return None

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


@dataclass
class Layout:
    root: Item
    dialect: Dialect

    def items(self) -> list[Item]:
        return list(self.root.walk())

    def find(self, name: str) -> Item | None:
        """The first item of that name in order, whatever the case; never FILLER."""
        return next((i for i in self.root.walk() if not i.field.filler and same_name(i.name, name)), None)

    @property
    def tables(self) -> list[Item]:
        return [i for i in self.root.walk() if i.control is not None]

    @property
    def variable(self) -> bool:
        return bool(self.tables)

    @property
    def max_length(self) -> int:
        return self.root.total_.value(lambda t: t.max_occurs)

    @property
    def min_length(self) -> int:
        return self.root.total_.value(lambda t: t.min_occurs)

    @property
    def length(self) -> int:
        return 0 if self.variable else self.max_length

    def rows(self, counts: dict[str, int] | None = None) -> list[dict]:
        """One dict per item: the static layout, or that of a record with these counts."""
        known = {k.upper(): v for k, v in (counts or {}).items()}

        def count(t: Item) -> int:
            n = known.get((t.name or "").upper(), t.max_occurs)
            if not t.min_occurs <= n <= t.max_occurs:
                raise errors.DependingError(f"{t.name}: {n} occurrences are not within {t.min_occurs} to {t.max_occurs}")
            return n

        return [
            {"name": i.name or "FILLER", "level": i.field.entry.level, "offset": i.at.value(count), "length": i.length_.value(count), "stride": i.stride_.value(count), "occurs": i.count.value(count), "slack": i.slack_.value(count), "picture": i.field.entry.picture, "usage": "group" if i.field.is_group else i.field.usage}
            for i in self.items()
        ]

    def occurrence_offset(self, item: Item, n: int) -> int:
        """Offset of occurrence n, from 0, at the maximum layout."""
        if not 0 <= n < item.max_occurs:
            raise errors.OccurrenceError(f"{item.name}: occurrence {n} is not within 0 to {item.max_occurs - 1}")
        most = lambda t: t.max_occurs
        return item.at.value(most) + n * item.stride_.value(most)


def lay_out(record: Field, dialect: Dialect) -> Layout:
    """Widths, offsets, slack and strides of a record under a dialect."""
    dialect.validate()
    placed: list[Item] = []

    def where(f: Field) -> str:
        return f"line {f.entry.line}: {f.name or 'FILLER'}"

    def occurrences(f: Field) -> tuple[int, int, Item | None]:
        e = f.entry
        if e.occurs is None:
            return 1, 1, None
        first, last = e.occurs
        if e.depending is None:
            if last is not None:
                raise errors.OccursError(f"{where(f)}: OCCURS {first} TO {last} without DEPENDING ON")
            if first < 1:
                raise errors.OccursError(f"{where(f)}: OCCURS {first}")
            return first, first, None
        low, high = (1, first) if last is None else (first, last)
        if high < 1 or high < low:
            raise errors.OccursError(f"{where(f)}: OCCURS {low} TO {high}")
        for item in placed:
            if not item.field.filler and same_name(item.name, e.depending):
                p = item.field.picture
                if item.field.is_group or p is None or p.category != picture.NUMERIC or p.scale != 0:
                    raise errors.DependingError(f"{where(f)}: {e.depending} holds no whole number")
                return low, high, item
        raise errors.DependingError(f"{where(f)}: no {e.depending} before the table")

    def width(item: Item) -> int:
        f, p = item.field, item.field.picture
        if f.usage in ("comp-1", "comp-2"):
            return 4 if f.usage == "comp-1" else 8
        if f.usage == "index":
            return dialect.index_width
        if f.usage == "pointer":
            return dialect.pointer_width
        if p is None:
            raise errors.LayoutError(f"{where(f)}: no PICTURE")
        if f.usage == "display":
            return p.size + item.separate_sign()
        if p.category != picture.NUMERIC:
            raise errors.LayoutError(f"{where(f)}: usage {f.usage} of a picture that is {p.category}")
        if p.digits > 31:
            raise errors.DigitCountError(f"{where(f)}: {p.digits} digits are more than 31")
        if f.usage == "comp-3":
            return p.digits // 2 + 1
        if f.usage == "comp-6":
            if p.signed:
                raise errors.LayoutError(f"{where(f)}: COMP-6 is unsigned")
            return (p.digits + 1) // 2
        return binary_width(p.digits, dialect.binary)

    def natural(f: Field) -> int:
        if f.is_group or f.entry.sync is None or dialect.sync == "ignored":
            return 1
        if f.usage == "comp-2":
            return 8
        if f.usage in ("comp-1",):
            return 4
        if f.usage in ("display", "comp-3", "comp-6"):
            return 1
        w = dialect.index_width if f.usage == "index" else dialect.pointer_width if f.usage == "pointer" else binary_width(f.picture.digits, dialect.binary) if f.picture else 1
        return 1 if w <= 1 else 2 if w <= 2 else 4 if w <= 4 else 8

    def boundary(f: Field) -> int:
        if not f.is_group:
            return natural(f)
        return max((natural(x) for x in f.walk()), default=1) if f.entry.occurs is not None else 1

    def place(f: Field, parent: Item | None, at: Expr, target: Item | None) -> Item:
        low, high, control = occurrences(f)
        align = 1 if target is not None else boundary(f)
        start = at.up_to(align)
        item = Item(f, parent, start, low, high, control, redefines=target)
        if start != at:
            item.slack_ = const(start.args[0] - at.args[0]) if start.op == at.op == "const" else Expr("add", (start, Expr("mul", (at, const(-1)))))
        placed.append(item)
        if f.is_group:
            if not f.children:
                raise errors.LayoutError(f"{where(f)}: a group without items")
            end = start
            for child in f.children:
                goal = _target(child, item)
                own = place(child, item, goal.at if goal else end, goal)
                item.children.append(own)
                if goal is not None and dialect.redefines == "strict" and own.total_.value(lambda t: t.max_occurs) > goal.total_.value(lambda t: t.max_occurs):
                    raise errors.RedefinesError(f"{where(child)}: longer than {goal.name}")
                new_end = own.at + own.total_
                end = new_end if goal is None else end.larger(new_end)
            item.length_ = _minus(end, start)
        else:
            item.length_ = const(width(item))
        item.stride_ = item.length_.up_to(align) if high > 1 else item.length_
        return item

    def _target(child: Field, group: Item) -> Item | None:
        if not child.entry.redefines:
            return None
        for item in group.children:
            if not item.field.filler and same_name(item.name, child.entry.redefines):
                return item
        raise errors.RedefinesError(f"{where(child)}: no {child.entry.redefines} before it in its group")

    return Layout(place(record, None, const(0), None), dialect)


def _minus(end: Expr, start: Expr) -> Expr:
    if start.op == end.op == "const":
        return const(end.args[0] - start.args[0])
    if start == const(0):
        return end
    return Expr("add", (end, Expr("mul", (start, const(-1)))))
