"""COBOL source text to tokens, in free and fixed format, with COPY expansion.

Words start with a letter. In fixed format columns 1-6 and 73 on are ignored, column 7 marks
comments, debugging lines and continuations. After PICTURE or PIC the next text is one token.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .. import errors

COMMENT, WORD, SYMBOL, STRING, NUMBER, PICTURE, DEBUG, PSEUDO = "Comment", "Identifier", "Symbol", "String", "Number", "Picture", "Debug", "PseudoText"


@dataclass(frozen=True)
class Token:
    line: int
    column: int
    type: str
    value: str

    def is_word(self, *words: str) -> bool:
        return self.type == WORD and self.value.upper() in words

    def is_symbol(self, value: str) -> bool:
        return self.type == SYMBOL and self.value == value


_RULES = re.compile(
    r"""(?P<comment>\*>[^\n]*)
    |(?P<pseudo>==.*?==)
    |(?P<string>"(?:[^"\n]|"")*"|'(?:[^'\n]|'')*')
    |(?P<number>[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?![A-Za-z0-9_-]))
    |(?P<word>[A-Za-z][A-Za-z0-9_-]*)
    |(?P<level>[0-9]+)
    |(?P<symbol>\*\*|>=|<=|<>|[.(),;:+\-*/=<>&])
    |(?P<space>\s+)""",
    re.VERBOSE | re.DOTALL,
)
_COMMA_NUMBER = re.compile(r"(?P<number>[+-]?[0-9]+(?:,[0-9]+)?)")
_PICTURE = re.compile(r"[^\s]+?(?=[.,;]?(?:\s|$))")


def _fixed_lines(source: str) -> tuple[str, list[tuple[int, int]], list[Token]]:
    """Free text of a fixed-format source, the line each of its lines starts on, and side tokens.

    A literal that is continued fills its line up to column 72, blanks included.
    """
    out: list[str] = []
    places: list[tuple[int, int]] = []
    aside: list[Token] = []
    piece, room = 0, 65  # where the last physical line starts in out[-1], and its columns
    for n, raw in enumerate(source.split("\n"), 1):
        line = raw.rstrip("\r").expandtabs(8)
        mark, area = line[6:7], line[7:72]
        if mark in ("*", "/"):
            aside.append(Token(n, 7, COMMENT, line[6:72].rstrip()))
        elif mark in ("D", "d"):
            aside.append(Token(n, 7, DEBUG, area.rstrip()))
        elif mark == "-" and out:
            rest, quote = area.lstrip(), _open_quote(out[-1])
            if quote:
                if not rest.startswith(quote):
                    raise errors.UnterminatedStringError(f"line {n}: a continued literal must start with {quote}")
                out[-1] = out[-1][:piece] + out[-1][piece:].ljust(room)
                rest = rest[1:]
            else:
                out[-1] = out[-1].rstrip()
            piece, room = len(out[-1]), 65 - (len(area) - len(rest))
            out[-1] += rest.rstrip() if not _open_quote(out[-1] + rest) else rest
        else:
            out.append(area.rstrip() if not _open_quote(area) else area)
            places.append((n, 0))
            piece, room = 0, 65
    return "\n".join(out), places, aside


def _open_quote(line: str) -> str:
    quote = ""
    for c in line:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
    return quote


_TYPES = {"comment": COMMENT, "pseudo": PSEUDO, "string": STRING, "number": NUMBER, "level": NUMBER, "word": WORD, "symbol": SYMBOL}


def tokenize(source: str, fixed: bool = False, decimal_comma: bool = False) -> Iterator[Token]:
    """Tokens with their line and column, from 1."""
    aside: list[Token] = []
    places: list[tuple[int, int]] = []
    if fixed:
        source, places, aside = _fixed_lines(source)
    at, line, start, picture, side = 0, 1, 0, False, 0

    def place(index: int) -> tuple[int, int]:
        if fixed:
            return places[line - 1][0] if line <= len(places) else line, index - start + 8
        return line, index - start + 1

    while at < len(source):
        m = None
        if picture and not source[at].isspace():
            m = _PICTURE.match(source, at)
            if m and m[0].upper() == "IS":
                m = None
            elif m:
                yield Token(*place(at), PICTURE, m[0])
                picture, at = False, m.end()
                continue
        m = _RULES.match(source, at)
        if m and m.lastgroup == "number" and decimal_comma:
            m = _COMMA_NUMBER.match(source, at) or m
        if not m:
            if source[at] in "\"'":
                raise errors.UnterminatedStringError(f"{place(at)}: literal without an end")
            if source.startswith("==", at):
                raise errors.UnterminatedPseudoTextError(f"{place(at)}: pseudo-text without an end")
            raise errors.UnexpectedCharacterError(f"{place(at)}: {source[at]!r}")
        kind, text = m.lastgroup, m[0]
        here = place(at)
        while side < len(aside) and aside[side].line < here[0]:
            yield aside[side]
            side += 1
        if kind == "number" and text[0] in "+-" and at and source[at - 1] not in " \t\n(,;":
            kind, text = "symbol", text[0]
        if kind not in ("space",) and not (kind == "symbol" and text in ",;"):
            yield Token(*here, _TYPES[kind], text)
            picture = kind == "word" and text.upper() in ("PIC", "PICTURE") or picture and kind == "word" and text.upper() == "IS"
        at += len(text)
        lines = text.count("\n")
        if lines:
            line, start = line + lines, at - (len(text) - text.rfind("\n") - 1)
    yield from aside[side:]


Resolver = Callable[[str, str], str]


def map_copybooks(books: dict[str, str]) -> Resolver:
    """Copybooks from a dict, whatever the case: LIBRARY.NAME first, then NAME."""
    known = {k.upper(): v for k, v in books.items()}

    def resolve(name: str, library: str) -> str:
        for key in ([f"{library}.{name}"] if library else []) + [name]:
            if key.upper() in known:
                return known[key.upper()]
        raise errors.CopyBookNotFoundError(f"no copybook {name}" + (f" in {library}" if library else ""))

    return resolve


def table_copybooks(files, suffixes: tuple[str, ...] = ("", ".cpy", ".CPY")) -> Resolver:
    """Copybooks from a DataFrame of `path` and `content` text, such as a listed folder.

    COPY name OF library looks in the folder named library, and COPY name anywhere, nearest to the
    top first. The library comes to the driver: copybooks are source text, of a size a person wrote.
    """
    rows = sorted(((r["path"], r["content"]) for r in files.select("path", "content").toLocalIterator()), key=lambda r: (r[0].count("/"), r[0]))
    known: dict[str, str] = {}
    for path, content in rows:
        parts = path.split("/")
        known.setdefault(parts[-1], content)
        known.setdefault("/".join(parts[-2:]), content)

    def resolve(name: str, library: str) -> str:
        for folder in ([library, library.upper(), library.lower()] if library else [""]):
            for stem in (name, name.upper(), name.lower()):
                for suffix in suffixes:
                    key = f"{folder}/{stem}{suffix}" if folder else stem + suffix
                    if key in known:
                        return known[key]
        raise errors.CopyBookNotFoundError(f"no copybook {name}" + (f" in {library}" if library else ""))

    return resolve


def _strip(token: Token) -> str:
    return token.value[1:-1] if token.type == STRING else token.value


def _text_words(tokens: list[Token]) -> list[tuple[str, str]]:
    return [(t.type, t.value if t.type == STRING else t.value.upper()) for t in tokens]


def expand(tokens: Iterator[Token], resolver: Resolver | None = None, fixed: bool = False, open_: tuple[str, ...] = (), decimal_comma: bool = False) -> Iterator[Token]:
    """Tokens with listing directives dropped and every COPY replaced by its copybook."""
    own = iter(tokens)
    fresh = True
    for t in own:
        if fresh and t.is_word("EJECT", "SKIP1", "SKIP2", "SKIP3"):
            continue
        if fresh and t.is_word("TITLE"):
            following = next(own, None)
            if following is not None and following.type == STRING:
                continue
            yield t
            if following is None:
                return
            t = following
        if not t.is_word("COPY"):
            fresh = t.is_symbol(".") or fresh and t.type == COMMENT
            yield t
            continue
        statement = []
        for u in own:
            if u.is_symbol("."):
                break
            if u.type != COMMENT:
                statement.append(u)
        else:
            raise errors.UnexpectedEndOfTokensError(f"line {t.line}: COPY without an end")
        if not statement or statement[0].type not in (WORD, STRING):
            raise errors.UnexpectedTokenError(f"line {t.line}: COPY needs a name")
        name, library, at = _strip(statement[0]), "", 1
        if at + 1 < len(statement) and statement[at].is_word("OF", "IN"):
            library, at = _strip(statement[at + 1]), at + 2
        pairs = []
        if at < len(statement):
            if not statement[at].is_word("REPLACING"):
                raise errors.UnexpectedTokenError(f"line {statement[at].line}: {statement[at].value}")
            operands, at = [], at + 1
            while at < len(statement):
                if statement[at].is_word("BY"):
                    at += 1
                    continue
                u = statement[at]
                operands.append(list(tokenize(u.value[2:-2], False, decimal_comma)) if u.type == PSEUDO else [u])
                at += 1
            if not operands or len(operands) % 2:
                raise errors.UnexpectedTokenError(f"line {t.line}: REPLACING needs pairs")
            pairs = list(zip(operands[::2], operands[1::2], strict=True))
        if resolver is None:
            raise errors.MissingCopyBookResolverError(f"line {t.line}: COPY {name} without a library")
        if name.upper() in open_:
            raise errors.CopyBookCycleError(" -> ".join((*open_, name.upper())))
        book = [u for u in expand(tokenize(resolver(name, library), fixed, decimal_comma), resolver, fixed, (*open_, name.upper()), decimal_comma)]
        yield from _replace(book, pairs)
        fresh = True


def _replace(book: list[Token], pairs: list) -> Iterator[Token]:
    """Text words of the copybook that equal an operand, one after another, are replaced."""
    at = 0
    while at < len(book):
        for old, new in pairs:
            n = len(old)
            if n and _text_words(book[at : at + n]) == _text_words(old):
                for u in new:
                    yield Token(book[at].line, book[at].column, u.type, u.value)
                at += n
                break
        else:
            yield book[at]
            at += 1
