"""COBOL programs to syntax trees, and trees to canonical free-format text.

A node keeps its written form: keywords in canonical order and spelling, and children with
their roles. The printer walks that form, so printing and parsing cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from .. import errors
from . import copybook, lexer
from .lexer import COMMENT, NUMBER, STRING, SYMBOL, WORD, Token


@dataclass
class Node:
    kind: str
    line: int = 0
    column: int = 0
    attrs: dict[str, str] = field(default_factory=dict)
    form: list = field(default_factory=list)  # keyword, (role, Node), or "\n" + indent markers

    def add(self, *parts) -> Node:
        self.form += [p for p in parts if p]
        return self

    def child(self, role: str, node: Node | None) -> Node:
        if node is not None:
            self.form.append((role, node))
        return self

    def children(self) -> list[tuple[str, Node]]:
        return [p for p in self.form if isinstance(p, tuple)]

    def same(self, other: Node) -> bool:
        """Equal but for positions."""
        mine, theirs = self.children(), other.children()
        return (self.kind, self.attrs, len(mine)) == (other.kind, other.attrs, len(theirs)) and all(a == b and x.same(y) for (a, x), (b, y) in zip(mine, theirs, strict=True))


IN, OUT, LINE = "\x01", "\x02", "\x03"  # indent, dedent and line break in a form

#: The verbs, figurative constants, phrase words, classes and signs of the language.
VERBS = {"DISPLAY", "MOVE", "ACCEPT", "CALL", "GO", "CONTINUE", "GOBACK", "IF", "NEXT", "PERFORM", "ADD", "SUBTRACT", "MULTIPLY", "DIVIDE", "COMPUTE", "STOP", "EXIT", "OPEN", "CLOSE", "READ", "WRITE", "REWRITE", "DELETE", "START", "SORT", "MERGE", "RELEASE", "RETURN", "EVALUATE", "INITIALIZE", "SET", "STRING", "UNSTRING", "INSPECT", "SEARCH"}
FIGURATIVE = {"ZERO", "ZEROS", "ZEROES", "SPACE", "SPACES", "HIGH-VALUE", "HIGH-VALUES", "LOW-VALUE", "LOW-VALUES", "QUOTE", "QUOTES", "NULL", "NULLS"}
#: Words that end a list of operands.
PHRASES = {"TO", "FROM", "BY", "INTO", "GIVING", "UPON", "WITH", "NO", "ON", "NOT", "AT", "INVALID", "SIZE", "ROUNDED", "REMAINDER", "USING", "RETURNING", "UNTIL", "TIMES", "VARYING", "AFTER", "BEFORE", "THROUGH", "THRU", "DEPENDING", "ELSE", "THEN", "WHEN", "ALSO", "OTHER", "DELIMITED", "DELIMITER", "COUNT", "POINTER", "TALLYING", "REPLACING", "CONVERTING", "OVERFLOW", "END", "END-OF-PAGE", "EOP", "KEY", "ASCENDING", "DESCENDING", "DUPLICATES", "COLLATING", "INPUT", "OUTPUT", "I-O", "EXTEND", "REVERSED", "LOCK", "NEXT", "PREVIOUS", "RECORD", "ADVANCING", "FOR", "CHARACTERS", "LEADING", "ALL", "FIRST", "INITIAL", "UP", "DOWN", "IN", "OF", "IS", "EXCEPTION", "AND", "OR", "VALUE", "DEFAULT", "FILLER", "TEST"}
SCOPE_ENDS = {f"END-{v}" for v in VERBS}
CLASSES = {"NUMERIC", "ALPHABETIC", "ALPHABETIC-LOWER", "ALPHABETIC-UPPER"}
SIGNS = {"POSITIVE", "NEGATIVE", "ZERO"}
DIVISIONS = ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")


class Parser:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, Token]] = []  # with the place of the token that follows
        for t in tokens:
            if t.type == COMMENT:
                self.comments.append((len(self.tokens), t))
            else:
                self.tokens.append(t)
        self.at = self.noted = 0

    # tokens

    def peek(self, ahead: int = 0) -> Token | None:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else None

    def next(self) -> Token:
        t = self.peek()
        if t is None:
            raise errors.UnexpectedEndOfTokensError("the source ends too early")
        self.at += 1
        return t

    def sees(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t is not None and t.is_word(*words)

    def symbol(self, value: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t is not None and t.is_symbol(value)

    def take(self, *words: str) -> str:
        return self.next().value.upper() if self.sees(*words) else ""

    def eat(self, value: str) -> bool:
        if self.symbol(value):
            self.at += 1
            return True
        return False

    def fail(self) -> None:
        t = self.peek()
        if t is None:
            raise errors.UnexpectedEndOfTokensError("the source ends too early")
        raise errors.UnexpectedTokenError(f"line {t.line}, column {t.column}: unexpected {t.value!r}")

    def must(self, *words: str) -> str:
        t = self.peek()
        if t is not None and t.type == WORD and not t.is_word(*words):
            raise errors.UnexpectedKeywordError(f"line {t.line}, column {t.column}: {t.value!r} where {' or '.join(words)} should stand")
        return self.take(*words) or self.fail()

    def need(self, value: str) -> None:
        if not self.eat(value):
            self.fail()

    def node(self, kind: str, /, **attrs) -> Node:
        t = self.peek()
        return Node(kind, t.line if t else 0, t.column if t else 0, {k: str(v) for k, v in attrs.items() if v not in (None, "", False)})

    def noting(self, kind: str, /, **attrs) -> Node:
        """A node that takes the comments before it, each on a line of its own."""
        n = self.node(kind, **attrs)
        while self.noted < len(self.comments) and self.comments[self.noted][0] <= self.at:
            t = self.comments[self.noted][1]
            text = t.value.lstrip("*>/").strip()
            n.child("comment", Node("Comment", t.line, t.column, {"text": text}).add(f"*> {text}".rstrip())).add(LINE)
            self.noted += 1
        return n

    # operands and expressions

    def word(self) -> Node:
        n, t = self.node("Word"), self.next()
        if t.type != WORD:
            self.at -= 1
            self.fail()
        n.attrs["value"] = t.value
        return n.add(t.value)

    def procedure_name(self) -> Node:
        """A paragraph or section name, which may be all digits."""
        n, t = self.node("Word"), self.next()
        if t.type not in (WORD, NUMBER):
            self.at -= 1
            self.fail()
        n.attrs["value"] = t.value
        return n.add(t.value)

    def is_operand(self) -> bool:
        t = self.peek()
        return t is not None and (t.type in (STRING, NUMBER) or t.type == WORD and (t.value.upper() in FIGURATIVE or t.is_word("ALL", "FUNCTION") or t.value.upper() not in VERBS | PHRASES and t.value.upper() not in SCOPE_ENDS))

    def operand(self) -> Node:
        t = self.peek()
        if t is None:
            self.fail()
        if t.type in (STRING, NUMBER):
            n = self.node("StringLiteral" if t.type == STRING else "NumericLiteral", value=t.value)
            self.at += 1
            return n.add(t.value)
        if t.is_word("ALL"):
            n = self.node("AllLiteral")
            self.at += 1
            return n.add("ALL").child("of", self.operand())
        if t.is_word("FUNCTION"):
            n = self.node("FunctionReference")
            self.at += 1
            return self._suffix(n.add("FUNCTION").child("name", self.word()), "argument")
        return self.identifier()

    def identifier(self) -> Node:
        t = self.peek()
        if t is None or t.type != WORD:
            self.fail()
        n = self.node("Identifier").child("name", self.word())
        while word := self.take("IN", "OF"):
            n.add(word).child("qualifier", self.word())
        return self._suffix(n, "subscript")

    def _suffix(self, n: Node, role: str) -> Node:
        for _ in range(2):
            if not self.symbol("("):
                break
            start = self.at
            self.at += 1
            items = [self.expr()] if not self.symbol(")") else []
            if items and self.eat(":"):
                ref = Node("ReferenceModifier", items[0].line, items[0].column).child("start", items[0]).add(":")
                if not self.symbol(")"):
                    ref.child("length", self.expr())
                self.need(")")
                n.add("(").child("modifier", ref).add(")")
                break
            if any(r == role for r, _ in n.children()):
                self.at = start
                break
            while not self.symbol(")"):
                items.append(self.expr())
            self.need(")")
            n.add("(")
            for i in items:
                n.child(role, i)
            n.add(")")
        return n

    def expr(self) -> Node:
        left = self.term()
        while True:
            t = self.peek()
            if t is not None and t.type == NUMBER and t.value[0] in "+-":
                self.tokens[self.at] = Token(t.line, t.column + 1, NUMBER, t.value[1:])
                left = Node("BinaryExpr", left.line, left.column, {"op": t.value[0]}).child("left", left).add(t.value[0]).child("right", self.term())
                continue
            if t is None or not (t.is_symbol("+") or t.is_symbol("-")):
                return left
            left = Node("BinaryExpr", left.line, left.column, {"op": self.next().value}).child("left", left).add(t.value).child("right", self.term())

    def term(self) -> Node:
        left = self.factor()
        while self.symbol("*") or self.symbol("/"):
            op = self.next().value
            left = Node("BinaryExpr", left.line, left.column, {"op": op}).child("left", left).add(op).child("right", self.factor())
        return left

    def factor(self) -> Node:
        left = self._signed()
        while self.eat("**"):
            left = Node("BinaryExpr", left.line, left.column, {"op": "**"}).child("left", left).add("**").child("right", self._signed())
        return left

    def _signed(self) -> Node:
        if self.symbol("+") or self.symbol("-"):
            n = self.node("UnaryExpr")
            n.attrs["op"] = self.next().value
            return n.add(n.attrs["op"]).child("operand", self._signed())
        if self.symbol("("):
            n = self.node("ParenExpr")
            self.at += 1
            n.add("(").child("expr", self.expr())
            self.need(")")
            return n.add(")")
        return self.operand()

    # conditions

    def condition(self) -> Node:
        return self._logical("OR", lambda: self._logical("AND", self._negated))

    def _logical(self, op: str, part) -> Node:
        left = part()
        while self.take(op):
            left = Node("LogicalCondition", left.line, left.column, {"op": op}).child("left", left).add(op).child("right", part())
        return left

    def _negated(self) -> Node:
        if self.sees("NOT"):
            n = self.node("NotCondition")
            self.at += 1
            return n.add("NOT").child("cond", self._negated())
        return self._simple()

    def _operator(self) -> str:
        start = self.at
        self.take("IS")
        no = "NOT " if self.take("NOT") else ""
        t = self.peek()
        if t is not None and t.type == SYMBOL and t.value in ("=", "<", ">", "<=", ">=", "<>"):
            self.at += 1
            return no + t.value
        word = self.take("GREATER", "LESS", "EQUAL", "EQUALS")
        if not word:
            self.at = start
            return ""
        self.take("THAN", "TO")
        op = {"GREATER": ">", "LESS": "<"}.get(word, "=")
        if op != "=" and self.sees("OR") and self.sees("EQUAL", ahead=1):
            self.at += 2
            self.take("TO")
            op += "="
        return no + op

    def _simple(self) -> Node:
        if self.symbol("("):
            start, kept, n = self.at, list(self.tokens), self.node("ParenCondition")
            try:
                self.at += 1
                inner = self.condition()
                self.need(")")
                t = self.peek()
                if not (inner.kind == "ConditionNameCondition" and t is not None and (t.type == SYMBOL and t.value not in (".", ")") or t.is_word("IS", "GREATER", "LESS", "EQUAL", *CLASSES, *SIGNS))) and not (t is not None and t.type == SYMBOL and t.value in "+-*/**"):
                    return n.add("(").child("cond", inner).add(")")
            except errors.MainframeError:
                pass
            self.at, self.tokens = start, kept
        left = self.expr()
        at = {"line": left.line, "column": left.column}
        op = self._operator()
        if op:
            return Node("RelationCondition", **at, attrs={"op": op}).child("left", left).add(op).child("right", self.expr())
        start = self.at
        self.take("IS")
        no = bool(self.take("NOT"))
        if word := self.take(*CLASSES):
            return Node("ClassCondition", **at, attrs={"class": word, **({"not": "true"} if no else {})}).child("operand", left).add("IS", "NOT" if no else "", word)
        if word := self.take(*SIGNS):
            return Node("SignCondition", **at, attrs={"sign": word, **({"not": "true"} if no else {})}).child("operand", left).add("IS", "NOT" if no else "", word)
        self.at = start
        if left.kind != "Identifier":
            self.fail()
        return Node("ConditionNameCondition", **at).child("name", left)

    # statements

    def statements(self) -> list[Node]:
        out = []
        while (t := self.peek()) is not None and t.type == WORD and t.value.upper() in VERBS:
            out.append(self.statement())
        return out

    def statement(self) -> Node:
        verb = self.peek().value.upper()
        name = {"GO": "GoTo", "ADD": "Arithmetic", "SUBTRACT": "Arithmetic", "MULTIPLY": "Arithmetic", "DIVIDE": "Arithmetic", "NEXT": "NextSentence"}.get(verb, verb.title())
        n = self.node(name + "Statement")
        self.at += 1
        n.add(verb)
        getattr(self, "_" + {"ADD": "arithmetic", "SUBTRACT": "arithmetic", "MULTIPLY": "arithmetic", "DIVIDE": "arithmetic", "NEXT": "next_sentence"}.get(verb, verb.lower()))(n, verb)
        return n

    def body(self, n: Node, role: str) -> Node:
        n.add(IN)
        for s in self.statements():
            n.add(LINE).child(role, s)
        return n.add(OUT)

    def many(self, n: Node, role: str, part, stop=None) -> Node:
        count = 0
        while self.is_operand() and not (stop and stop()):
            n.child(role, part())
            count += 1
        if not count:
            self.fail()
        return n

    def phrase(self, n: Node, kinds: tuple[str, ...], end: str) -> Node:
        """ON/AT phrases with their statements, and the scope terminator."""
        while True:
            start = self.at
            no = bool(self.take("NOT"))
            self.take("ON", "AT")
            word = self.take(*kinds)
            if not word or word == "SIZE" and not self.take("ERROR"):
                self.at = start
                break
            if word == "INVALID":
                self.take("KEY")
            text = {"SIZE": "ON SIZE ERROR", "END": "AT END", "INVALID": "INVALID KEY", "OVERFLOW": "ON OVERFLOW", "EXCEPTION": "ON EXCEPTION", "END-OF-PAGE": "AT END-OF-PAGE", "EOP": "AT END-OF-PAGE"}[word]
            n.attrs[("not_" if no else "") + "handler"] = text
            n.add(LINE, "NOT" if no else "", text)
            self.body(n, "not_on" if no else "on")
        if self.take(end):
            n.attrs["end"] = "true"
            n.add(LINE, end)
        return n

    def _display(self, n, verb):
        self.many(n, "operand", self.operand)
        if self.take("UPON"):
            n.add("UPON").child("upon", self.word())
        if self.sees("WITH") or self.sees("NO"):
            self.take("WITH")
            self.must("NO")
            self.must("ADVANCING")
            n.attrs["no_advancing"] = "true"
            n.add("WITH NO ADVANCING")

    def _move(self, n, verb):
        if self.take("CORRESPONDING", "CORR"):
            n.attrs["corresponding"] = "true"
            n.add("CORRESPONDING")
        n.child("source", self.operand())
        self.must("TO")
        self.many(n.add("TO"), "target", self.identifier)

    def _accept(self, n, verb):
        n.child("target", self.identifier())
        if self.take("FROM"):
            n.add("FROM").child("from", self.word())

    def _call(self, n, verb):
        n.child("target", self.operand())
        if self.take("USING"):
            n.add("USING")
            while True:
                a, mode = self.node("CallArgument"), ""
                if self.take("BY"):
                    mode = self.must("REFERENCE", "CONTENT", "VALUE")
                else:
                    mode = self.take("REFERENCE", "CONTENT", "VALUE")
                if not mode and not self.is_operand():
                    break
                a.attrs |= {"mode": mode} if mode else {}
                n.child("using", a.add(f"BY {mode}" if mode else "").child("operand", self.operand()))
        if self.take("RETURNING"):
            n.add("RETURNING").child("returning", self.identifier())
        self.phrase(n, ("EXCEPTION", "OVERFLOW"), "END-CALL")

    def _go(self, n, verb):
        self.take("TO")
        n.add("TO")
        while self.peek() is not None and self.peek().type in (WORD, NUMBER) and not self.sees("DEPENDING", "ELSE", "WHEN", "NOT", "ON", "AT", "INVALID") and self.peek().value.upper() not in VERBS and self.peek().value.upper() not in SCOPE_ENDS:
            n.child("target", self.procedure_name())
        if self.take("DEPENDING"):
            self.take("ON")
            n.add("DEPENDING ON").child("depending", self.identifier())

    def _continue(self, n, verb):
        pass

    def _goback(self, n, verb):
        pass

    def _next_sentence(self, n, verb):
        self.must("SENTENCE")
        n.add("SENTENCE")

    def _if(self, n, verb):
        n.child("cond", self.condition())
        self.take("THEN")
        self.body(n, "then")
        if self.take("ELSE"):
            n.attrs["has_else"] = "true"
            self.body(n.add(LINE, "ELSE"), "else")
        if self.take("END-IF"):
            n.attrs["end"] = "true"
            n.add(LINE, "END-IF")

    def _varying(self, n, word):
        v = self.node("VaryingClause").add(word).child("name", self.identifier())
        self.must("FROM")
        v.add("FROM").child("from", self.operand())
        self.must("BY")
        v.add("BY").child("by", self.operand())
        self.must("UNTIL")
        n.child("varying" if word == "VARYING" else "after", v.add("UNTIL").child("until", self.condition()))

    def _perform(self, n, verb):
        t = self.peek()
        times = self.is_operand() and self.sees("TIMES", ahead=1)
        if t is not None and t.type in (WORD, NUMBER) and not times and t.value.upper() not in VERBS | {"WITH", "TEST", "UNTIL", "VARYING"} | SCOPE_ENDS:
            n.child("target", self.procedure_name())
            if self.take("THROUGH", "THRU"):
                n.add("THROUGH").child("through", self.procedure_name())
        else:
            n.attrs["inline"] = "true"
        if self.is_operand() and not self.sees("WITH", "TEST"):
            start = self.at
            count = self.operand()
            if self.take("TIMES"):
                n.child("times", count).add("TIMES")
            else:
                self.at = start
        if self.sees("WITH") or self.sees("TEST"):
            self.take("WITH")
            self.must("TEST")
            when = self.must("BEFORE", "AFTER")
            n.attrs |= {"test": when}
            n.add("WITH TEST", when)
        if self.take("UNTIL"):
            n.add("UNTIL").child("until", self.condition())
        elif self.take("VARYING"):
            self._varying(n, "VARYING")
            while self.take("AFTER"):
                self._varying(n, "AFTER")
        if "inline" in n.attrs:
            self.body(n, "body")
            if self.take("END-PERFORM"):
                n.attrs["end"] = "true"
                n.add(LINE, "END-PERFORM")

    def _rounded(self) -> Node:
        n = self.node("ArithmeticTarget").child("name", self.operand())
        if self.take("ROUNDED"):
            n.attrs["rounded"] = "true"
            n.add("ROUNDED")
        return n

    def _arithmetic(self, n, verb):
        n.attrs["verb"] = verb
        if self.take("CORRESPONDING", "CORR"):
            n.attrs["corresponding"] = "true"
            n.add("CORRESPONDING")
        self.many(n, "operand", self.operand)
        if word := self.take("TO", "FROM", "BY", "INTO"):
            n.attrs["connector"] = word
            self.many(n.add(word), "target", self._rounded)
        if self.take("GIVING"):
            self.many(n.add("GIVING"), "giving", self._rounded)
        if self.take("REMAINDER"):
            n.add("REMAINDER").child("remainder", self.identifier())
        self.phrase(n, ("SIZE",), f"END-{verb}")

    def _compute(self, n, verb):
        while not (self.symbol("=") or self.sees("EQUAL")):
            n.child("target", self._rounded())
        self.at += 1
        n.add("=").child("expr", self.expr())
        self.phrase(n, ("SIZE",), "END-COMPUTE")

    def _stop(self, n, verb):
        if self.take("RUN"):
            n.attrs["run"] = "true"
            n.add("RUN")
        else:
            n.child("literal", self.operand())

    def _exit(self, n, verb):
        if word := self.take("PROGRAM", "PARAGRAPH", "SECTION", "PERFORM"):
            n.attrs["option"] = word
            n.add(word)

    def _open(self, n, verb):
        while mode := self.take("INPUT", "OUTPUT", "I-O", "EXTEND"):
            g = self.node("OpenGroup", mode=mode).add(mode)
            while self.is_operand():
                g.child("file", self._file())
            n.child("group", g)
        if not n.children():
            self.fail()

    def _file(self) -> Node:
        f, option = self.node("File").child("name", self.word()), ""
        if self.take("REVERSED"):
            option = "REVERSED"
        elif self.sees("WITH", "NO", "LOCK", "FOR", "REEL", "UNIT"):
            self.take("REEL", "UNIT")
            self.take("WITH", "FOR")
            if self.take("NO"):
                self.must("REWIND")
                option = "WITH NO REWIND"
            elif self.take("LOCK"):
                option = "WITH LOCK"
            elif self.take("REMOVAL"):
                option = "FOR REMOVAL"
        if option:
            f.attrs["option"] = option
            f.add(option)
        return f

    def _close(self, n, verb):
        self.many(n, "file", self._file)

    def _read(self, n, verb):
        n.child("file", self.word())
        if word := self.take("NEXT", "PREVIOUS"):
            n.attrs["direction"] = word
            n.add(word)
        if self.take("RECORD"):
            n.attrs["record"] = "true"
            n.add("RECORD")
        if self.take("INTO"):
            n.add("INTO").child("into", self.identifier())
        if self.take("KEY"):
            self.take("IS")
            n.add("KEY IS").child("key", self.identifier())
        self.phrase(n, ("END", "INVALID"), "END-READ")

    def _write(self, n, verb):
        n.child("record", self.word())
        if self.take("FROM"):
            n.add("FROM").child("from", self.identifier())
        if when := self.take("BEFORE", "AFTER"):
            self.take("ADVANCING")
            a = self.node("AdvancingPhrase", when=when).add(when, "ADVANCING")
            if self.take("PAGE"):
                a.attrs["page"] = "true"
                a.add("PAGE")
            else:
                a.child("amount", self.operand())
                if word := self.take("LINE", "LINES"):
                    a.add(word)
            n.child("advancing", a)
        self.phrase(n, ("INVALID", "END-OF-PAGE", "EOP"), "END-WRITE")

    def _rewrite(self, n, verb):
        n.child("record", self.word())
        if self.take("FROM"):
            n.add("FROM").child("from", self.identifier())
        self.phrase(n, ("INVALID",), "END-REWRITE")

    def _delete(self, n, verb):
        n.child("file", self.word())
        if self.take("RECORD"):
            n.attrs["record"] = "true"
            n.add("RECORD")
        self.phrase(n, ("INVALID",), "END-DELETE")

    def _start(self, n, verb):
        n.child("file", self.word())
        if self.take("KEY"):
            op = self._operator() or self.fail()
            k = self.node("StartKey", op=op)
            n.add("KEY IS").child("key", k.add(op).child("name", self.identifier()))
        self.phrase(n, ("INVALID",), "END-START")

    def _keys(self, n):
        while True:
            start = self.at
            self.take("ON")
            up = self.take("ASCENDING", "DESCENDING")
            if not up:
                self.at = start
                return
            self.take("KEY")
            self.take("IS")
            k = self.node("SortKey", order=up).add("ON", up, "KEY")
            while self.is_operand():
                k.child("name", self.word())
            n.child("key", k)

    def _files(self, n, word, role):
        if self.take(word):
            self.many(n.add(word), role, self.word)
            return True
        return False

    def _procedure(self, n, word):
        if self.sees(word) and self.sees("PROCEDURE", ahead=1):
            self.at += 2
            self.take("IS")
            p = self.node("SortProcedure").add(word, "PROCEDURE IS").child("target", self.word())
            if self.take("THROUGH", "THRU"):
                p.add("THROUGH").child("through", self.word())
            n.child(word.lower(), p)

    def _sort(self, n, verb):
        n.child("file", self.word())
        self._keys(n)
        if self.sees("WITH", "DUPLICATES"):
            self.take("WITH")
            self.must("DUPLICATES")
            n.attrs["duplicates"] = "true"
            n.add("WITH DUPLICATES")
            if self.take("IN"):
                self.take("ORDER")
                n.attrs["in_order"] = "true"
                n.add("IN ORDER")
        if self.take("COLLATING"):
            self.must("SEQUENCE")
            self.take("IS")
            n.add("COLLATING SEQUENCE IS").child("collating", self.word())
        self._files(n, "USING", "using")
        self._procedure(n, "INPUT")
        self._files(n, "GIVING", "giving")
        self._procedure(n, "OUTPUT")

    _merge = _sort

    def _release(self, n, verb):
        n.child("record", self.word())
        if self.take("FROM"):
            n.add("FROM").child("from", self.identifier())

    def _return(self, n, verb):
        n.child("file", self.word())
        if self.take("RECORD"):
            n.attrs["record"] = "true"
            n.add("RECORD")
        if self.take("INTO"):
            n.add("INTO").child("into", self.identifier())
        self.phrase(n, ("END",), "END-RETURN")

    def _subject(self, kind: str) -> Node:
        s = self.node(kind)
        if word := self.take("TRUE", "FALSE", "ANY"):
            s.attrs["bool"] = word
            return s.add(word)
        if kind == "EvaluateObject" and self.sees("NOT"):
            start, kept = self.at, list(self.tokens)
            self.at += 1
            try:
                value = self.expr()
                if self._ends_object():
                    s.attrs["not"] = "true"
                    s.add("NOT").child("operand", value)
                    return self._through(s)
            except errors.MainframeError:
                pass
            self.at, self.tokens = start, kept
        start, kept = self.at, list(self.tokens)
        try:
            value = self.expr()
            if self._ends_object():
                return self._through(s.child("operand", value))
        except errors.MainframeError:
            pass
        self.at, self.tokens = start, kept
        return s.child("cond", self.condition())

    def _through(self, s: Node) -> Node:
        return s.add("THROUGH").child("through", self.expr()) if self.take("THROUGH", "THRU") else s

    def _ends_object(self) -> bool:
        t = self.peek()
        return t is None or t.is_word("ALSO", "WHEN", "THROUGH", "THRU", "END-EVALUATE", *VERBS) or t.is_symbol(".")

    def _evaluate(self, n, verb):
        n.child("subject", self._subject("EvaluateSubject"))
        while self.take("ALSO"):
            n.add("ALSO").child("subject", self._subject("EvaluateSubject"))
        n.add(IN)
        while self.take("WHEN"):
            n.add(LINE)
            if self.take("OTHER"):
                n.attrs["has_other"] = "true"
                self.body(n.add("WHEN OTHER"), "other")
                continue
            w = self.node("EvaluateWhen").add("WHEN").child("object", self._subject("EvaluateObject"))
            while self.take("ALSO"):
                w.add("ALSO").child("object", self._subject("EvaluateObject"))
            n.child("when", self.body(w, "body"))
        n.add(OUT)
        if self.take("END-EVALUATE"):
            n.add(LINE, "END-EVALUATE")

    def _initialize(self, n, verb):
        self.many(n, "target", self.identifier, lambda: self.sees("TO", ahead=1) and self.sees("VALUE", ahead=2) or self.sees("VALUE", ahead=1))
        if self.sees("WITH", "FILLER"):
            self.take("WITH")
            self.must("FILLER")
            n.attrs["filler"] = "true"
            n.add("WITH FILLER")
        if self.sees("ALL", "ALPHABETIC", "ALPHANUMERIC", "NUMERIC") and (self.sees("TO", ahead=1) or self.sees("VALUE", ahead=1)):
            n.child("to_value", self.word())
            self.take("TO")
            self.must("VALUE")
            n.add("TO VALUE")
        self.take("THEN")
        if self.take("REPLACING"):
            n.add("REPLACING")
            while self.peek() is not None and self.peek().type == WORD and self.peek(1) is not None and (self.sees("DATA", ahead=1) or self.sees("BY", ahead=1)):
                r = self.node("InitializeReplace").child("category", self.word())
                if self.take("DATA"):
                    r.attrs["data"] = "true"
                    r.add("DATA")
                self.must("BY")
                n.child("replacing", r.add("BY").child("by", self.operand()))
        self.take("THEN")
        if self.sees("TO") and self.sees("DEFAULT", ahead=1) or self.sees("DEFAULT"):
            self.take("TO")
            self.must("DEFAULT")
            n.attrs["default"] = "true"
            n.add("TO DEFAULT")

    def _address(self) -> Node:
        if self.take("ADDRESS"):
            n = self.node("AddressOf").add("ADDRESS OF")
            self.take("OF")
            return n.child("of", self.identifier())
        return self.operand()

    def _set(self, n, verb):
        while not self.sees("TO", "UP", "DOWN"):
            n.child("target", self._address())
        if word := self.take("UP", "DOWN"):
            self.must("BY")
            n.attrs["mode"] = word + " BY"
            n.add(word + " BY").child("value", self.expr())
            return
        self.must("TO")
        n.add("TO")
        if word := self.take("TRUE", "FALSE", "ON", "OFF"):
            n.attrs["mode"] = word
            n.add(word)
        else:
            n.attrs["mode"] = "TO"
            n.child("value", self._address() if self.sees("ADDRESS") else self.expr())

    def _pointer(self, n):
        start = self.at
        self.take("WITH")
        if self.take("POINTER"):
            n.add("WITH POINTER").child("pointer", self.identifier())
        else:
            self.at = start

    def _string(self, n, verb):
        while not self.sees("INTO"):
            s = self.node("StringSource")
            self.many(s, "operand", self.operand)
            if self.take("DELIMITED"):
                self.take("BY")
                s.add("DELIMITED BY")
                if self.take("SIZE"):
                    s.attrs["delimiter"] = "SIZE"
                    s.add("SIZE")
                else:
                    s.child("delimiter", self.operand())
            n.child("source", s)
        self.must("INTO")
        n.add("INTO").child("into", self.identifier())
        self._pointer(n)
        self.phrase(n, ("OVERFLOW",), "END-STRING")

    def _unstring(self, n, verb):
        n.child("source", self.identifier())
        if self.take("DELIMITED"):
            self.take("BY")
            n.add("DELIMITED BY")
            while True:
                d = self.node("UnstringDelimiter")
                if self.take("ALL"):
                    d.attrs["all"] = "true"
                    d.add("ALL")
                n.child("delimiter", d.child("value", self.operand()))
                if not self.take("OR"):
                    break
                n.add("OR")
        self.must("INTO")
        n.add("INTO")
        while self.is_operand():
            t = self.node("UnstringTarget").child("into", self.identifier())
            if self.take("DELIMITER"):
                self.take("IN")
                t.add("DELIMITER IN").child("delimiter", self.identifier())
            if self.take("COUNT"):
                self.take("IN")
                t.add("COUNT IN").child("count", self.identifier())
            n.child("target", t)
        self._pointer(n)
        if self.take("TALLYING"):
            self.take("IN")
            n.add("TALLYING IN").child("tallying", self.identifier())
        self.phrase(n, ("OVERFLOW",), "END-UNSTRING")

    def _region(self, n):
        while word := self.take("BEFORE", "AFTER"):
            r = self.node("InspectRegion", kind=word).add(word)
            if self.take("INITIAL"):
                r.attrs["initial"] = "true"
                r.add("INITIAL")
            n.child("region", r.child("operand", self.operand()))

    def _inspect(self, n, verb):
        n.child("target", self.identifier())
        if self.take("TALLYING"):
            n.add("TALLYING")
            while self.is_operand() and not self.sees("ALL"):
                t = self.node("InspectTally").child("count", self.identifier())
                self.must("FOR")
                t.add("FOR")
                while word := self.take("CHARACTERS", "ALL", "LEADING", "FIRST"):
                    m = self.node("InspectMatch", kind=word).add(word)
                    if word != "CHARACTERS":
                        m.child("item", self.operand())
                    self._region(m)
                    t.child("match", m)
                n.child("tallying", t)
        if self.take("REPLACING"):
            n.add("REPLACING")
            while word := self.take("CHARACTERS", "ALL", "LEADING", "FIRST"):
                r = self.node("InspectReplace", kind=word).add(word)
                if word != "CHARACTERS":
                    r.child("item", self.operand())
                self.must("BY")
                r.add("BY").child("by", self.operand())
                self._region(r)
                n.child("replacing", r)
        if self.take("CONVERTING"):
            c = self.node("InspectConvert").add("CONVERTING").child("from", self.operand())
            self.must("TO")
            c.add("TO").child("to", self.operand())
            self._region(c)
            n.child("converting", c)
        if len(n.children()) < 2:
            self.fail()

    def _search(self, n, verb):
        if self.take("ALL"):
            n.attrs["all"] = "true"
            n.add("ALL")
        n.child("target", self.identifier())
        if self.take("VARYING"):
            n.add("VARYING").child("varying", self.identifier())
        if self.sees("AT", "END"):
            self.take("AT")
            self.must("END")
            n.attrs["at_end"] = "true"
            self.body(n.add("AT END"), "at_end")
        whens = 0
        while self.take("WHEN"):
            w = self.node("SearchWhen").add("WHEN")
            cond = self.condition()
            whens += 1
            if "all" in n.attrs and (whens > 1 or not _plain(cond)):
                raise errors.SearchAllConstraintError(f"line {w.line}: SEARCH ALL takes one WHEN of equalities and condition-names joined by AND")
            n.add(LINE).child("when", self.body(w.child("cond", cond), "body"))
        if self.take("END-SEARCH"):
            n.attrs["end"] = "true"
            n.add(LINE, "END-SEARCH")

    # structure

    def file(self, fragment: bool = False, empty: bool = False) -> Node:
        """Programs one after another; with `fragment` data description entries and nothing else."""
        n = self.node("File")
        if fragment:
            n.child("fragment", self.entries(self.node("Fragment"), "entry", True))
            t = self.peek()
            if t is not None:
                raise errors.TrailingTokenError(f"line {t.line}, column {t.column}: {t.value!r} behind the entries of a fragment")
            return n
        while self.peek() is not None:
            n.child("program", self.program())
            n.add(LINE)
        if not n.children() and not empty:
            raise errors.UnexpectedEndOfTokensError("no program")
        return n

    def division(self, *names: str) -> bool:
        return self.sees(*names) and self.sees("DIVISION", ahead=1)

    def program(self) -> Node:
        n = self.noting("Program")
        if not self.division("IDENTIFICATION", "ID"):
            self.fail()
        n.child("division", self.identification())
        if self.division("ENVIRONMENT"):
            n.add(LINE).child("division", self.environment())
        if self.division("DATA"):
            n.add(LINE).child("division", self.data())
        if self.division("PROCEDURE"):
            n.add(LINE).child("division", self.procedure())
        while self.division("IDENTIFICATION", "ID"):
            mark = self.at
            if not self._nested(mark):
                break
            n.add(LINE).child("nested", self.program())
        if self.sees("END") and self.sees("PROGRAM", ahead=1):
            self.at += 2
            n.add(LINE, "END PROGRAM").child("end", self.operand()).add(".")
            self.need(".")
        return n

    def _nested(self, mark: int) -> bool:
        """A program inside this one ends with END PROGRAM before this one does."""
        depth, ends = 0, 0
        for i in range(mark, len(self.tokens) - 1):
            a, b = self.tokens[i], self.tokens[i + 1]
            if a.is_word("IDENTIFICATION", "ID") and b.is_word("DIVISION"):
                depth += 1
            elif a.is_word("END") and b.is_word("PROGRAM"):
                ends += 1
                if ends > depth:
                    return True
        return False

    def _header(self, kind: str, name: str) -> Node:
        n = self.noting(kind)
        self.at += 2
        self.need(".")
        return n.add(name + " DIVISION.")

    def identification(self) -> Node:
        n = self._header("IdentificationDivision", "IDENTIFICATION")
        self.must("PROGRAM-ID")
        self.eat(".")
        p = self.node("ProgramID").add("PROGRAM-ID.").child("name", self.operand()).add(".")
        self.need(".")
        return n.add(LINE).child("program_id", p)

    def environment(self) -> Node:
        n = self._header("EnvironmentDivision", "ENVIRONMENT")
        if self.sees("CONFIGURATION"):
            self.at += 1
            self.must("SECTION")
            self.need(".")
            c = self.node("ConfigurationSection").add("CONFIGURATION SECTION.")
            while word := self.take("SOURCE-COMPUTER", "OBJECT-COMPUTER", "SPECIAL-NAMES"):
                self.need(".")
                p = self.node({"SOURCE-COMPUTER": "SourceComputerParagraph", "OBJECT-COMPUTER": "ObjectComputerParagraph"}.get(word, "SpecialNamesParagraph")).add(word + ".")
                if word == "SPECIAL-NAMES":
                    while not self.symbol("."):
                        if self.take("DECIMAL-POINT"):
                            self.take("IS")
                            self.must("COMMA")
                            p.child("clause", Node("DecimalPointClause").add("DECIMAL-POINT IS COMMA"))
                        else:
                            self.must("CURRENCY")
                            self.take("SIGN")
                            self.take("IS")
                            p.child("clause", self.node("CurrencySignClause").add("CURRENCY SIGN IS").child("sign", self.operand()))
                else:
                    p.child("name", self.word())
                    if self.sees("WITH", "DEBUGGING"):
                        self.take("WITH")
                        self.must("DEBUGGING")
                        self.must("MODE")
                        p.attrs["debugging"] = "true"
                        p.add("WITH DEBUGGING MODE")
                self.need(".")
                c.add(LINE).child("paragraph", p.add("."))
            n.add(LINE).child("configuration", c)
        if self.sees("INPUT-OUTPUT"):
            self.at += 1
            self.must("SECTION")
            self.need(".")
            s = self.node("InputOutputSection").add("INPUT-OUTPUT SECTION.")
            if self.take("FILE-CONTROL"):
                self.need(".")
                s.add(LINE, "FILE-CONTROL.", IN)
                while self.sees("SELECT"):
                    s.add(LINE).child("entry", self._select())
                s.add(OUT)
            n.add(LINE).child("input_output", s)
        return n

    def _select(self) -> Node:
        n = self.node("FileControlEntry").add("SELECT")
        self.at += 1
        if self.take("OPTIONAL"):
            n.attrs["optional"] = "true"
            n.add("OPTIONAL")
        n.child("name", self.word())
        self.must("ASSIGN")
        self.take("TO")
        n.add("ASSIGN TO").child("assign", self.operand())
        while not self.symbol("."):
            if self.take("ORGANIZATION"):
                self.take("IS")
                words = [self.next().value.upper()]
                if words[0] == "LINE":
                    words.append(self.must("SEQUENTIAL"))
                n.child("clause", Node("OrganizationClause", attrs={"organization": " ".join(words)}).add("ORGANIZATION IS", *words))
            elif self.take("ACCESS"):
                self.take("MODE")
                self.take("IS")
                mode = self.must("SEQUENTIAL", "RANDOM", "DYNAMIC")
                n.child("clause", Node("AccessClause", attrs={"mode": mode}).add("ACCESS MODE IS", mode))
            elif self.take("RECORD"):
                self.take("KEY")
                self.take("IS")
                n.child("clause", self.node("RecordKeyClause").add("RECORD KEY IS").child("name", self.word()))
            elif self.take("FILE", "STATUS"):
                self.take("STATUS")
                self.take("IS")
                n.child("clause", self.node("FileStatusClause").add("FILE STATUS IS").child("name", self.word()))
            else:
                self.fail()
        self.need(".")
        return n.add(".")

    def entries(self, n: Node, role: str, last: bool = False) -> Node:
        """Data description entries, with a node for each clause; the indentation follows their levels.

        With `last` the comments behind the last entry belong to n.
        """
        stack: list[int] = []
        while (t := self.peek()) is not None and t.type == NUMBER and t.value.isdigit():
            e, start = self.noting("DataDescriptionEntry"), self.at
            while not self.symbol("."):
                self.next()
            own = self.tokens[start : self.at + 1]
            self.at += 1
            level = int(own[0].value)
            if not (1 <= level <= 49 or level in (66, 77, 88)):
                raise errors.InvalidLevelNumberError(f"line {t.line}: level {level}")
            entry = copybook.entry_of(own)
            if level in (1, 77, 66):
                stack = [level] if level != 66 else []
            elif level != 88:
                while stack and stack[-1] >= level:
                    stack.pop()
                stack.append(level)
            depth = len(stack) if level == 88 else max(0, len(stack) - 1)
            e.attrs |= {"level": f"{level:02d}", "name": entry.name or ("FILLER" if entry.filler else "")}
            e.add(f"{level:02d}", e.attrs["name"])
            for tokens, clause in copybook.clauses_of(own):
                e.child("clause", _clause_node(tokens, clause))
            e.attrs["clauses"] = " ".join(_text(c) for r, c in e.children() if r == "clause")
            e.add(".")
            n.add(*([IN] * depth), LINE).child(role, e).add(*([OUT] * depth))
        if last:
            for _, t in self.comments[self.noted :]:
                text = t.value.lstrip("*>/").strip()
                n.add(LINE).child("comment", Node("Comment", t.line, t.column, {"text": text}).add(f"*> {text}".rstrip()))
            self.noted = len(self.comments)
        return n

    def data(self) -> Node:
        n = self._header("DataDivision", "DATA")
        while self.sees("FILE", "WORKING-STORAGE", "LOCAL-STORAGE", "LINKAGE") and self.sees("SECTION", ahead=1):
            s = self.node("FileSection" if self.sees("FILE") else "DataSection")
            name = self.next().value.upper()
            self.at += 1
            self.need(".")
            s.attrs["name"] = name
            s.add(name + " SECTION.")
            if name == "FILE":
                while word := self.take("FD", "SD"):
                    f = self.node("FileDescriptionEntry", kind=word).add(word).child("name", self.word()).add(".")
                    self.need(".")
                    s.add(LINE).child("file", self.entries(f, "record"))
            else:
                self.entries(s, "entry")
            n.add(LINE).child("section", s)
        return n

    def procedure(self) -> Node:
        n = self.noting("ProcedureDivision").add("PROCEDURE DIVISION")
        self.at += 2
        if self.take("USING"):
            n.add("USING")
            while not self.symbol(".") and not self.sees("RETURNING"):
                mode = ""
                if self.take("BY"):
                    mode = self.must("REFERENCE", "VALUE")
                n.child("using", self.node("Parameter", mode=mode).add(f"BY {mode}" if mode else "").child("name", self.word()))
        if self.take("RETURNING"):
            n.add("RETURNING").child("returning", self.word())
        self.need(".")
        n.add(".")
        if self.take("DECLARATIVES"):
            self.need(".")
            n.add(LINE, "DECLARATIVES.")
            while not self.sees("END"):
                n.add(LINE).child("declarative", self._section(True))
            self.must("END")
            self.must("DECLARATIVES")
            self.need(".")
            n.add(LINE, "END DECLARATIVES.")
        while (t := self.peek()) is not None and not (self.sees("END") and self.sees("PROGRAM", ahead=1)) and not self.division("IDENTIFICATION", "ID"):
            if t.type in (WORD, NUMBER) and self.sees("SECTION", ahead=1):
                n.add(LINE).child("section", self._section(False))
            else:
                n.add(LINE).child("paragraph", self._paragraph())
        return n

    def _section(self, declarative: bool) -> Node:
        s = self.noting("DeclarativeSection" if declarative else "Section").child("name", self.procedure_name()).add("SECTION")
        self.must("SECTION")
        t = self.peek()
        if t is not None and t.type == NUMBER:
            s.child("segment", self.operand())
        self.need(".")
        s.add(".")
        if declarative:
            self.must("USE")
            u = self.node("UseStatement").add("USE")
            words = []
            while not self.symbol("."):
                words.append(self.next().value)
            self.need(".")
            upper = [w.upper() for w in words]
            u.attrs["spec"] = " ".join(upper)
            u.attrs["form"] = "debugging" if "DEBUGGING" in upper else "reporting" if "REPORTING" in upper else "exception" if {"EXCEPTION", "ERROR"} & set(upper) else "other"
            if "GLOBAL" in upper:
                u.attrs["global"] = "true"
            last = max((k for k, w in enumerate(upper) if w in ("ON", "REPORTING", "PROCEDURE", "DEBUGGING")), default=len(words) - 1)
            u.add(*upper[: last + 1])
            for w in words[last + 1 :]:
                u.child("target", Node("Word", u.line, u.column, {"value": w}).add(w))
            s.add(LINE).child("use", u.add("."))
        while (t := self.peek()) is not None and not (t.type in (WORD, NUMBER) and self.sees("SECTION", ahead=1)) and not (self.sees("END") and self.sees("PROGRAM", "DECLARATIVES", ahead=1)) and not self.division("IDENTIFICATION", "ID"):
            s.add(LINE).child("paragraph", self._paragraph())
        return s

    def _paragraph(self) -> Node:
        p, t = self.noting("Paragraph"), self.peek()
        if t.type in (WORD, NUMBER) and self.symbol(".", ahead=1) and t.value.upper() not in ("CONTINUE", "GOBACK", "EXIT"):
            p.child("name", self.procedure_name()).add(".")
            self.at += 1
        p.add(IN)
        any_ = any(r == "name" for r, _ in p.children())
        while (t := self.peek()) is not None and t.type == WORD and t.value.upper() in VERBS:
            s = self.noting("Sentence")
            for k, x in enumerate(self.statements()):
                s.add(LINE if k else "").child("statement", x)
            self.need(".")
            p.add(LINE).child("sentence", s.add("."))
            any_ = True
        if not any_:
            self.fail()
        return p.add(OUT)


def _plain(cond: Node) -> bool:
    if cond.kind == "LogicalCondition":
        return cond.attrs["op"] == "AND" and all(_plain(c) for _, c in cond.children())
    return cond.kind == "ConditionNameCondition" or cond.kind == "RelationCondition" and cond.attrs["op"] == "="


def _text(n: Node) -> str:
    return " ".join(_text(p[1]) if isinstance(p, tuple) else p for p in n.form)


def _clause_node(tokens: list[Token], e: copybook.Entry) -> Node:
    """A data clause as a node of its own kind, whose form is its canonical spelling."""
    def make(kind: str, *form: str, **attrs) -> Node:
        return Node(kind, tokens[0].line, tokens[0].column, {k: str(v) for k, v in attrs.items() if v not in (None, "", False)}).add(*form)

    def word(value: str) -> Node:
        at = next((t for t in tokens if t.value == value), tokens[0])
        return Node("Word", at.line, at.column, {"value": value}).add(value)

    if e.redefines:
        return make("RedefinesClause", "REDEFINES").child("name", word(e.redefines))
    if e.picture is not None:
        return make("PictureClause", "PIC", e.picture, picture=e.picture)
    if e.usage:
        usage = tokens[-1].value.upper()
        return make("UsageClause", "USAGE", usage, usage=usage)
    if e.values:
        n = make("ValueClause", "VALUE")
        for low, high in e.values:
            v = make("ValueRange" if high else "ValueSpec", low, **{"from": low, "through": high})
            n.child("value", v.add("THROUGH", high) if high else v)
        return n
    if e.occurs:
        low, high = e.occurs
        n = make("OccursClause", "OCCURS", str(low), *(("TO", str(high)) if high is not None else ()), "TIMES", min=low, max=high)
        if e.depending:
            n.add("DEPENDING ON").child("depending", word(e.depending))
        for up, key in e.keys:
            k = make("OccursKey", "ASCENDING" if up else "DESCENDING", "KEY IS", order="ASCENDING" if up else "DESCENDING")
            n.child("key", k.child("name", word(key)))
        return n.add("INDEXED BY").child("index", word(e.indexed)) if e.indexed else n
    if e.sign:
        place = e.sign[0].upper()
        return make("SignClause", "SIGN IS", place, "SEPARATE CHARACTER" if e.sign[1] else "", position=place, separate="true" if e.sign[1] else "")
    if e.justified:
        return make("JustifiedClause", "JUSTIFIED RIGHT")
    if e.sync:
        side = "" if e.sync == "default" else e.sync.upper()
        return make("SynchronizedClause", "SYNCHRONIZED", side, direction=side)
    if e.blank_when_zero:
        return make("BlankWhenZeroClause", "BLANK WHEN ZERO")
    if e.renames:
        n = make("RenamesClause", "RENAMES").child("from", word(e.renames[0]))
        return n.add("THROUGH").child("through", word(e.renames[1])) if e.renames[1] else n
    return make("GlobalClause", "GLOBAL") if e.is_global else make("ExternalClause", "EXTERNAL")


def parse(source: str, fixed: bool = False, resolver: lexer.Resolver | None = None, fragment: bool = False, decimal_comma: bool = False, empty: bool = False) -> Node:
    """A source of one or more programs to its tree.

    With `fragment` it is a copybook of data description entries and nothing else. `empty` lets
    a source without any program be an empty file. `decimal_comma` reads 1,5 as a number.
    """
    tokens = lexer.expand(lexer.tokenize(source, fixed, decimal_comma), resolver, fixed, decimal_comma=decimal_comma)
    return Parser(list(tokens)).file(fragment, empty)


def print_source(node: Node) -> str:
    """Canonical free-format text of a tree."""
    out: list[str] = [""]
    depth = 0

    def walk(n: Node) -> None:
        nonlocal depth
        if not n.form and n.kind not in ("File", "Fragment", "Paragraph"):
            raise errors.UnsupportedNodeError(f"line {n.line}: a {n.kind or 'nameless'} node has no printed form")
        for part in n.form:
            if part == IN:
                depth += 1
            elif part == OUT:
                depth -= 1
            elif part == LINE:
                out.append("    " * depth)
            elif isinstance(part, tuple):
                walk(part[1])
            else:
                glue = not out[-1].strip() or part in (".", ")", ":") or out[-1].endswith(("(", ":"))
                out[-1] += part if glue else " " + part

    walk(node)
    text = "\n".join(line.rstrip() for line in out if line.strip())
    return text + "\n" if text else ""


def rows(node: Node) -> Iterator[tuple[int, int | None, int, str, str, int, int, dict]]:
    """(node, parent, ordinal, role, kind, line, column, attrs) of every node, parents first."""
    count = 0
    stack = [(node, None, 0, "file")]
    while stack:
        n, parent, ordinal, role = stack.pop()
        own = count
        count += 1
        yield own, parent, ordinal, role, n.kind, n.line, n.column, n.attrs
        for k, (r, c) in reversed(list(enumerate(n.children()))):
            stack.append((c, own, k, r))
