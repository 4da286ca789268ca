"""The query language: types, `*`, and clauses on tags, compiled to a predicate.

    query   = selector ("," selector)*
    selector = ("*" | one or more of n w a r) clause*
    clause  = "[" key "]" | "[" "!" key "]" | "[" key op value ("," value)* "]"
    op      = "=" | "!=" | "<" | "<=" | ">" | ">="

n: nodes, w: ways that are no areas, a: areas, r: relations that are no areas. `*` stands for all types; in a value, a leading or
trailing `*` is a wildcard. Values may be quoted by ' or "; quoted values have no wildcards. Several values mean any of them, and for
`!=` none of them. Lists of selectors, several values, comparisons, and wildcards other than a trailing one go beyond the forms
that the original language is known to have.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Value:
    text: str
    quoted: bool = False

    @property
    def wild(self) -> bool:
        return not self.quoted and len(self.text) > 1 and (self.text.startswith("*") or self.text.endswith("*"))


@dataclass(frozen=True)
class Clause:
    key: str
    op: str
    values: tuple[Value, ...] = ()


@dataclass(frozen=True)
class Selector:
    types: str
    clauses: tuple[Clause, ...] = ()


class QueryError(ValueError):
    """A query that cannot be read; the message says where."""


_WORD = re.compile(r"[^\s\[\]=!<>,'\"]+")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, *options: str) -> str | None:
        self.blank()
        for o in options:
            if self.text.startswith(o, self.at):
                self.at += len(o)
                return o
        return None

    def need(self, option: str) -> None:
        if not self.take(option):
            raise QueryError(f"{option!r} expected at {self.at + 1} in {self.text!r}")

    def word(self) -> Value:
        self.blank()
        quote = self.text[self.at : self.at + 1]
        if quote and quote in "'\"":
            end, out = self.at + 1, []
            while end < len(self.text) and self.text[end] != quote:
                if self.text[end] == "\\" and end + 1 < len(self.text):
                    end += 1
                out.append(self.text[end])
                end += 1
            if end >= len(self.text):
                raise QueryError(f"quote not closed in {self.text!r}")
            self.at = end + 1
            return Value("".join(out), True)
        m = re.compile(r"[^\[\],'\"]+").match(self.text, self.at)
        if not m or not m[0].strip():
            raise QueryError(f"value expected at {self.at + 1} in {self.text!r}")
        self.at = m.end()
        return Value(m[0].strip())

    def key(self) -> str:
        self.blank()
        if self.text[self.at : self.at + 1] in ("'", '"'):
            return self.word().text
        m = _WORD.match(self.text, self.at)
        if not m:
            raise QueryError(f"key expected at {self.at + 1} in {self.text!r}")
        self.at = m.end()
        return m[0]


def parse(text: str) -> list[Selector]:
    """Selectors of a query; QueryError where it cannot be read."""
    r, out = _Reader(text), []
    while True:
        r.blank()
        if r.take("*"):
            types = "nwar"
        else:
            m = re.compile(r"[nwar]+").match(r.text, r.at)
            if not m or len(set(m[0])) != len(m[0]):
                raise QueryError(f"feature types (n, w, a, r or *) expected at {r.at + 1} in {text!r}")
            types, r.at = m[0], m.end()
        clauses = []
        while r.take("["):
            if r.take("!"):
                clauses.append(Clause(r.key(), "absent"))
            else:
                key, op = r.key(), r.take("!=", "<=", ">=", "=", "<", ">")
                values = []
                while op:
                    values.append(r.word())
                    if not r.take(","):
                        break
                if op not in (None, "=", "!=") and not re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", values[0].text):
                    raise QueryError(f"a number must follow {op} in {text!r}")
                clauses.append(Clause(key, op or "present", tuple(values)))
            r.need("]")
        out.append(Selector(types, tuple(clauses)))
        if not r.take(","):
            break
    r.blank()
    if r.at < len(text):
        raise QueryError(f"unexpected {text[r.at :]!r} in {text!r}")
    return out


def _match(tag: Column, value: Value) -> Column:
    if not value.wild:
        return tag == value.text
    head, tail = value.text.startswith("*"), value.text.endswith("*")
    core = value.text.strip("*") if head and tail else value.text[1:] if head else value.text[:-1]
    return tag.contains(core) if head and tail else tag.endswith(core) if head else tag.startswith(core)


def _clause(c: Clause, tags: Column) -> Column:
    tag = F.try_element_at(tags, F.lit(c.key))
    if c.op in ("present", "absent"):
        has = F.coalesce(F.map_contains_key(tags, c.key), F.lit(False))
        return has if c.op == "present" else ~has
    if c.op in ("=", "!="):
        hit = F.coalesce(reduce(lambda a, b: a | b, (_match(tag, v) for v in c.values)), F.lit(False))
        return hit if c.op == "=" else ~hit
    n, at = tag.try_cast("double"), float(c.values[0].text)
    hit = {"<": n < at, "<=": n <= at, ">": n > at, ">=": n >= at}[c.op]
    return F.coalesce(hit, F.lit(False))


def types_predicate(types: str, ftype: Column, is_area: Column) -> Column:
    """The predicate of a set of types; it is on plain columns, so a store partitioned or sorted by them is pruned."""
    if set(types) == set("nwar"):
        return F.lit(True)
    parts = {"n": ftype == "node", "w": (ftype == "way") & ~is_area, "a": is_area, "r": (ftype == "relation") & ~is_area}
    return reduce(lambda a, b: a | b, (parts[t] for t in types))


def predicate(query: str | list[Selector], ftype: Column | None = None, is_area: Column | None = None, tags: Column | None = None) -> Column:
    """The predicate of a query over columns `ftype`, `is_area` and `tags`."""
    ftype, is_area, tags = F.col("ftype") if ftype is None else ftype, F.col("is_area") if is_area is None else is_area, F.col("tags") if tags is None else tags
    selectors = parse(query) if isinstance(query, str) else query
    each = [reduce(lambda a, b: a & b, (_clause(c, tags) for c in s.clauses), types_predicate(s.types, ftype, is_area)) for s in selectors]
    return reduce(lambda a, b: a | b, each)


def tags_predicate(query: str | list[Selector], types: str, tags: Column | None = None) -> Column:
    """What tags alone say: the clauses of some selector that accepts one of `types` hold. Every match of these types passes it."""
    tags = F.col("tags") if tags is None else tags
    selectors = [s for s in (parse(query) if isinstance(query, str) else query) if set(s.types) & set(types)]
    each = [reduce(lambda a, b: a & b, (_clause(c, tags) for c in s.clauses), F.lit(True)) for s in selectors]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def needs_tag(query: str | list[Selector], types: str, but: str) -> bool:
    """Whether each selector that accepts one of `types` asks for a key that does not start with `but`, so that nothing untagged matches."""
    selectors = [s for s in (parse(query) if isinstance(query, str) else query) if set(s.types) & set(types)]
    return all(any(c.op in ("present", "=", "<", "<=", ">", ">=") and not c.key.startswith(but) for c in s.clauses) for s in selectors)


def accepted_types(query: str | list[Selector]) -> str:
    """All types that some selector accepts, in the order n w a r."""
    selectors = parse(query) if isinstance(query, str) else query
    return "".join(t for t in "nwar" if any(t in s.types for s in selectors))


def required_keys(query: str | list[Selector]) -> set[str]:
    """Keys that every match must have: a store's index bits can be tested for them before its tags are read."""
    selectors = parse(query) if isinstance(query, str) else query
    need = [{c.key for c in s.clauses if c.op in ("present", "=", "<", "<=", ">", ">=")} for s in selectors]
    return set.intersection(*need) if need else set()
