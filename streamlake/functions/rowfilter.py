"""Row filters: the accepted texts and their column expressions.

A filter is a chain of ``column op value`` or ``column IN (value, ...)`` terms joined by AND
only, or by OR only, at most 200 characters long. Values are numbers, quoted strings without
quote or backslash inside, or ``current_user``. Letters, digits and white space are ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

# The comparison operators, the name of the caller, and the longest text.
OPERATORS = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
CALLER = "current_user"
MAX_LENGTH = 200

BLANKS = " \t\n\v\f\r"
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"


class Rejected(ValueError):
    pass


@dataclass
class Token:
    kind: str       # name, number, text, operator, mark or end
    text: str
    spaced: bool    # white space stands in front of it


def scan(text: str) -> list[Token]:
    """Cut a filter into tokens."""
    tokens, at = [], 0

    def run(begin: int, allowed: str) -> int:
        end = begin
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    while True:
        start = run(at, BLANKS)
        spaced = start > at
        if start == len(text):
            return [*tokens, Token("end", "", spaced)]
        first, two = text[start], text[start:start + 2]
        if first in LETTERS:
            kind, at = "name", run(start, LETTERS + DIGITS)
            if text[at:at + 1] == "." and text[at + 1:at + 2] and text[at + 1] in LETTERS:
                at = run(at + 1, LETTERS + DIGITS)
        elif first in DIGITS or first == "-":
            kind, at = "number", run(start + (first == "-"), DIGITS)
            if text[at:at + 1] == "." and run(at + 1, DIGITS) > at + 1:
                at = run(at + 1, DIGITS)
            if text[start:at] == "-":
                raise Rejected("a sign without a number")
        elif first == "'":
            close = text.find("'", start + 1)
            if close < 0 or "\\" in text[start:close]:
                raise Rejected("a text that is not closed or holds a backslash")
            kind, at = "text", close + 1
        elif two in OPERATORS or first in OPERATORS:
            kind, at = "operator", start + len(two if two in OPERATORS else first)
        elif first in "(),":
            kind, at = "mark", start + 1
        else:
            raise Rejected(f"{first} has no place in a filter")
        tokens.append(Token(kind, text[start:at], spaced))


def parse(text: str) -> tuple[str | None, list[tuple[str, str, list[Token]]]]:
    """``(connector, terms)``; a term is column, operator or ``IN``, and values."""
    if len(text) > MAX_LENGTH:
        raise Rejected("too long")
    tokens = iter(scan(text))
    connector, terms = None, []

    def value(token: Token) -> Token:
        if token.kind in ("number", "text") or (
                token.kind == "name" and token.text.lower() == CALLER):
            return token
        raise Rejected(f"{token.text or 'the end'} instead of a value")

    while True:
        column, relation = next(tokens), next(tokens, Token("end", "", False))
        if column.kind != "name":
            raise Rejected(f"{column.text or 'the end'} instead of a column")
        if relation.kind == "operator":
            terms.append((column.text, relation.text, [value(next(tokens))]))
        elif relation.kind == "name" and relation.text.lower() == "in":
            listed, mark = [], next(tokens)
            if mark.text != "(":
                raise Rejected("IN without a list")
            while mark.text != ")":
                listed.append(value(next(tokens)))
                mark = next(tokens)
                if mark.text not in (",", ")") or mark.kind != "mark":
                    raise Rejected("a list that is not closed")
            terms.append((column.text, "IN", listed))
        else:
            raise Rejected(f"{relation.text or 'the end'} instead of a comparison")
        joint = next(tokens)
        if joint.kind == "end":
            return connector, terms
        word = joint.text.lower()
        if joint.kind != "name" or word not in ("and", "or") or not joint.spaced:
            raise Rejected(f"{joint.text} between terms")
        if connector not in (None, word):
            raise Rejected("AND and OR in one filter")
        connector = word


def is_accepted(text: str) -> bool:
    try:
        parse(text)
    except Rejected:
        return False
    return True


def pattern(connector: str) -> str:
    """The same language as a regular expression for use inside a plan."""
    any_blank = "[ \\t\\n\\x0B\\f\\r]"
    word = "[a-z_][a-z_0-9]*"
    kinds = {
        "column": f"{word}([.]{word})?",
        "operator": "|".join(sorted(OPERATORS, key=len, reverse=True)),
        "value": f"-?[0-9]+([.][0-9]+)?|'[^'\\\\]*'|{CALLER}"}
    column, operator, value = (f"({kinds[k]})" for k in ("column", "operator", "value"))
    gap, space = f"{any_blank}*", f"{any_blank}+"
    listed = f"[(]{gap}{value}({gap},{gap}{value})*{gap}[)]"
    term = f"{column}({gap}{operator}{gap}{value}|{space}in{gap}{listed})"
    return f"(?i)^{gap}{term}({space}{connector}{space}{term})*{gap}\\z"


def accepted(text: Column) -> Column:
    """Is the text an accepted filter? The length test runs first and bounds the matching."""
    return F.when(F.length(text) > MAX_LENGTH, F.lit(False)).otherwise(
        text.rlike(pattern("and")) | text.rlike(pattern("or")))


def to_column(text: str, user: str) -> Column:
    """Column expression of an accepted filter; only literals and columns are ever built from
    the text, so nothing in it is run as SQL."""
    try:
        connector, terms = parse(text)
    except Rejected as why:
        raise ValueError(f"row filter rejected: {text} ({why})") from why

    def literal(token: Token) -> Column:
        if token.kind == "text":
            return F.lit(token.text[1:-1])
        return F.lit(user) if token.kind == "name" else F.expr(token.text)

    columns = [F.col(name).isin(*map(literal, values)) if relation == "IN"
               else OPERATORS[relation](F.col(name), literal(values[0]))
               for name, relation, values in terms]
    return reduce(or_ if connector == "or" else and_, columns)
