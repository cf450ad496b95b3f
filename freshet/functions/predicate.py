"""The task query language: a Python expression over kwargs and ``rule``, compiled to a column.

A name that the rule does not have makes the whole query false where it is evaluated; where ``and`` or ``or`` stops
before it, it does not matter. So each sub-expression has two columns: its value, and whether it raised. The
compiler takes names, constants, comparisons (also chained, ``in`` and ``is``), ``and``, ``or``, ``not``, arithmetic, and the
string methods startswith, endswith, lower, upper. Comparisons follow Python: None equals only None, an
ordering of None or of different kinds is an error and ends the job. ``evaluate`` is the plain evaluator over
one task's kwargs that the driver uses; nothing is ever passed to eval.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.errors import QueryError

_NUMBERS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.FloorDiv: operator.floordiv, ast.Pow: operator.pow}
_ORDER = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_METHODS = {"startswith": (1, lambda s, x: s.startswith(x)), "endswith": (1, lambda s, x: s.endswith(x)), "lower": (0, F.lower), "upper": (0, F.upper)}


class _Missing(Exception):
    """A name that the task does not have was evaluated."""


def parse(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise QueryError(f"cannot read the query {text!r}: {e}") from e


class _Compiler:
    def __init__(self, known: Iterable[str], rule: str, prefix: str):
        self.known, self.rule, self.prefix = set(known), rule, prefix

    def truth(self, node: ast.expr) -> tuple[Column, Column]:
        """(value, raised) of an expression whose truth is asked for."""
        yes, no = F.lit(True), F.lit(False)
        if isinstance(node, ast.BoolOp):
            value, raised = self.truth(node.values[0])
            for right in node.values[1:]:
                v, r = self.truth(right)
                if isinstance(node.op, ast.And):
                    raised, value = raised | (value & r), value & v
                else:
                    raised, value = raised | (~value & r), value | v
            return value, raised
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            value, raised = self.truth(node.operand)
            return ~value, raised
        if isinstance(node, ast.Compare):
            left, parts = node.left, []
            for op, right in zip(node.ops, node.comparators):
                parts.append(self.compared(left, op, right))
                left = right
            value, raised = parts[0]
            for v, r in parts[1:]:
                raised, value = raised | (value & r), value & v
            return value, raised
        if isinstance(node, ast.Constant):
            return (yes if node.value else no), no
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("startswith", "endswith"):
            value, raised = self.value(node)
            return F.coalesce(value, no), raised
        value, raised = self.value(node)
        # the truth of a value: not null, not zero, not empty
        text = value.cast("string")
        return F.coalesce((text != "") & (text != "false") & ~text.rlike(r"^-?0(\.0*)?$") | (F.typeof(value) == "string") & (text != ""), no), raised

    def compared(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> tuple[Column, Column]:
        a, ra = self.value(left)
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                items = [self.value(x) for x in right.elts]
                value, raised = F.lit(False), ra
                for v, r in items:
                    value, raised = value | a.eqNullSafe(v), raised | r
            else:
                b, rb = self.value(right)
                value, raised = F.coalesce(F.contains(b, a), F.lit(False)), ra | rb
            return (value if isinstance(op, ast.In) else ~value), raised
        b, rb = self.value(right)
        if isinstance(op, (ast.Eq, ast.Is)):
            return a.eqNullSafe(b), ra | rb
        if isinstance(op, (ast.NotEq, ast.IsNot)):
            return ~a.eqNullSafe(b), ra | rb
        # where a name is missing there is nothing to order: raising is for None among real values
        return F.when(ra | rb, F.lit(False)).otherwise(F.coalesce(_ORDER[type(op)](a, b), F.raise_error(F.lit("a query orders None")))), ra | rb

    def value(self, node: ast.expr) -> tuple[Column, Column]:
        no = F.lit(False)
        if isinstance(node, ast.Constant):
            return F.lit(node.value), no
        if isinstance(node, ast.Name):
            if node.id == "rule":
                return F.lit(self.rule), no
            if node.id in self.known:
                return F.col(f"`{self.prefix}{node.id}`"), no
            return F.lit(None), F.lit(True)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            v, r = self.value(node.operand)
            return (-v if isinstance(node.op, ast.USub) else v), r
        if isinstance(node, ast.BinOp) and type(node.op) in _NUMBERS:
            (a, ra), (b, rb) = self.value(node.left), self.value(node.right)
            if isinstance(node.op, ast.FloorDiv):
                out = F.floor(a / b)
            elif isinstance(node.op, ast.Mod):
                out = a - b * F.floor(a / b)  # the sign of the divisor, as in Python
            elif isinstance(node.op, ast.Pow):
                out = F.pow(a, b)
            else:
                out = _NUMBERS[type(node.op)](a, b)
            return out, ra | rb
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute) and node.func.attr in _METHODS and not node.keywords:
                n, make = _METHODS[node.func.attr]
                if len(node.args) == n:
                    parts = [self.value(node.func.value), *map(self.value, node.args)]
                    raised = parts[0][1]
                    for _, r in parts[1:]:
                        raised = raised | r
                    return make(*[v for v, _ in parts]), raised
            if isinstance(node.func, ast.Name):  # there are no built-in functions
                return F.lit(None), F.lit(True)
        if isinstance(node, (ast.Compare, ast.UnaryOp)):
            return self.truth(node)
        raise QueryError(f"a query cannot have {ast.unparse(node)!r}")


def compile_query(text: str, known: Iterable[str], rule: str, prefix: str = "") -> Column:
    """The column that is true for the tasks of ``rule``, with kwargs ``known`` in columns called ``prefix`` + name, that the
    query selects. The rule's name stands before a kwarg called ``rule``."""
    value, raised = _Compiler(known, rule, prefix).truth(parse(text))
    return value & ~raised


def evaluate(text: str, kwargs: Mapping, rule: str) -> bool:
    """The same for one task on the driver."""
    names = dict(kwargs) | {"rule": rule}

    def get(node: ast.expr):
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            if node.id not in names:
                raise _Missing(node.id)
            return names[node.id]
        if isinstance(node, ast.BoolOp):
            out = None
            for x in node.values:
                out = get(x)
                if bool(out) is isinstance(node.op, ast.Or):
                    break
            return out
        if isinstance(node, ast.UnaryOp):
            x = get(node.operand)
            return not x if isinstance(node.op, ast.Not) else -x if isinstance(node.op, ast.USub) else +x
        if isinstance(node, ast.BinOp) and type(node.op) in _NUMBERS:
            return _NUMBERS[type(node.op)](get(node.left), get(node.right))
        if isinstance(node, (ast.List, ast.Tuple, ast.Set)):
            return [get(x) for x in node.elts]
        if isinstance(node, ast.Compare):
            left = get(node.left)
            for op, node_right in zip(node.ops, node.comparators):
                right = get(node_right)
                test = {ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Is: operator.is_, ast.IsNot: operator.is_not}.get(type(op)) or _ORDER[type(op)]
                if not test(left, right):
                    return False
                left = right
            return True
        if isinstance(node, ast.Call):
            if isinstance(node.func, ast.Attribute) and node.func.attr in _METHODS and not node.keywords:
                return getattr(get(node.func.value), node.func.attr)(*map(get, node.args))
            if isinstance(node.func, ast.Name):
                raise _Missing(node.func.id)
        raise QueryError(f"a query cannot have {ast.unparse(node)!r}")

    try:
        return bool(get(parse(text)))
    except _Missing:
        return False
