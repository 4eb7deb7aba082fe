"""Boolean expressions: a parser to postfix tokens, and truth tables as column expressions.

Operators by rising strength: ``|`` ``+`` (or), ``^`` (exclusive or), ``&`` ``*`` or nothing between two
operands (and), ``!`` ``~`` before and ``'`` behind an operand (not).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:([()!~'&*|+^])|(\\\S+|[A-Za-z_][\w.$]*(?:\[\d+(?::\d+)?\])*)|([01])|(\S))")
STRENGTH = {"|": 1, "^": 2, "&": 3}
SPELLING = {"+": "|", "*": "&", "~": "!"}


class BooleanError(ValueError):
    """An expression that isn't of the language."""


def postfix(text: str) -> list[str]:
    """Tokens in postfix order: names, 0 and 1, and the operators ! & ^ |."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = text[1:-1]
    out: list[str] = []
    ops: list[str] = []
    operand = False

    def push(op: str):
        while ops and ops[-1] != "(" and (ops[-1] == "!" or STRENGTH[ops[-1]] >= STRENGTH[op]):
            out.append(ops.pop())
        ops.append(op)

    for m in TOKEN.finditer(text):
        sign, name, const, bad = m.groups()
        if bad:
            raise BooleanError(f"unexpected {bad!r} at {m.start(4)}")
        sign = SPELLING.get(sign, sign)
        if name or const or sign in ("(", "!"):
            if operand:
                push("&")
            if sign:
                ops.append(sign)
                operand = False
            else:
                out.append(name or const)
                operand = True
        elif not operand:
            raise BooleanError(f"an operand is missing at {m.start()}")
        elif sign == "'":
            out.append("!")
        elif sign == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise BooleanError("a bracket is not opened")
            ops.pop()
        else:
            push(sign)
            operand = False
    if not operand:
        raise BooleanError("an operand is missing at the end")
    while ops:
        if ops[-1] == "(":
            raise BooleanError("a bracket is not closed")
        out.append(ops.pop())
    return out


def variables(tokens: list[str]) -> list[str]:
    return sorted({t for t in tokens if t not in ("!", "&", "^", "|", "0", "1")})


def value(tokens: list[str], of: dict[str, Column]) -> Column:
    """The expression over Boolean columns."""
    stack: list[Column] = []
    for t in tokens:
        if t == "!":
            stack.append(~stack.pop())
        elif t in ("&", "|", "^"):
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if t == "&" else a | b if t == "|" else a != b)
        else:
            stack.append(F.lit(t == "1") if t in "01" else of[t])
    return stack.pop()


def evaluate(tokens: list[str], of: dict[str, bool]) -> bool:
    stack: list[bool] = []
    for t in tokens:
        if t == "!":
            stack.append(not stack.pop())
        elif t in ("&", "|", "^"):
            b, a = stack.pop(), stack.pop()
            stack.append(a and b if t == "&" else a or b if t == "|" else a != b)
        else:
            stack.append(t == "1" if t in "01" else of[t])
    return stack.pop()


def bits(names: list[str], assignment: Column) -> dict[str, Column]:
    """Variables of an assignment's number: the first name is the most significant bit."""
    return {n: F.shiftrightunsigned(assignment, len(names) - 1 - k).bitwiseAND(F.lit(1)) == 1 for k, n in enumerate(names)}


def truth_table(postfix_column: Column, names: Column, assignment: Column) -> Column:
    """An expression held as data: a stack machine folded over the tokens; the stack is an array."""
    at = lambda t: F.array_position(names, t)
    bit = lambda t: F.call_function("shiftrightunsigned", assignment, (F.size(names) - at(t)).cast("int")).bitwiseAND(F.lit(1)).cast("int")
    top = lambda s, k: F.element_at(s, F.lit(-k))
    rest = lambda s, k: F.slice(s, F.lit(1), F.size(s) - k)
    step = lambda s, t: (
        F.when(t == "!", F.concat(rest(s, 1), F.array(1 - top(s, 1))))
        .when(t == "&", F.concat(rest(s, 2), F.array(top(s, 1).bitwiseAND(top(s, 2)))))
        .when(t == "|", F.concat(rest(s, 2), F.array(top(s, 1).bitwiseOR(top(s, 2)))))
        .when(t == "^", F.concat(rest(s, 2), F.array(top(s, 1).bitwiseXOR(top(s, 2)))))
        .otherwise(F.concat(s, F.array(F.when(t == "0", 0).when(t == "1", 1).otherwise(bit(t)))))
    )
    return F.element_at(F.aggregate(postfix_column, F.array().cast("array<int>"), step), 1)
