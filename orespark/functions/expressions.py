"""Criteria texts in the syntax of data-frame queries, as Spark columns.

A text is parsed by Python's own parser and translated node by node: comparisons (chained ones too), `and or not`, `& | ~`, `in` and
`not in` with lists, arithmetic, numbers, texts, True, False and None, column names (back-quoted where they aren't identifiers) and
`@name`, a value given beside the text. As in such queries, & and | bind as loosely as and and or. Anything else is refused; nothing
is ever evaluated as Python.
"""

from __future__ import annotations

import ast
import io
import operator
import tokenize
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ingest import ref

COMPARISONS = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
ARITHMETIC = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}


class Refused(ValueError):
    """A criteria text that isn't a predicate of the kinds that are known."""


def _python(text: str) -> tuple[str, dict[str, str], dict[str, str]]:
    """The text in Python's syntax, and what its made-up names stand for: columns and given values."""
    parts = text.split("`")
    if len(parts) % 2 == 0:
        raise Refused(f"a back-quote isn't closed: {text}")
    columns = {f"_column_{i}": parts[i] for i in range(1, len(parts), 2)}
    plain = "".join(f" _column_{i} " if i % 2 else p for i, p in enumerate(parts))
    out, values, at = [], {}, False
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(plain.replace("\n", " ")).readline))
    except (tokenize.TokenError, SyntaxError) as e:
        raise Refused(f"not a predicate: {text}") from e
    for kind, word, *_ in tokens:
        if kind == tokenize.OP and word == "@":
            at = True
            continue
        if at:
            values[f"_value_{word}"] = word
            word = f"_value_{word}"
            at = False
        out.append({"&": "and", "|": "or", "~": "not"}.get(word, word) if kind == tokenize.OP else word)
    if at:
        raise Refused(f"@ without a name: {text}")
    return " ".join(out), columns, values


class _Translator:
    def __init__(self, df: DataFrame, columns: dict[str, str], values: dict[str, str], given: Mapping[str, object]):
        self.df, self.columns, self.values, self.given = df, columns, values, given

    def value(self, node: ast.AST) -> object:
        """A plain value: a constant, a given name, or a list of these."""
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float | str | bool | None):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
            return -node.operand.value
        if isinstance(node, ast.Name) and node.id in self.values:
            name = self.values[node.id]
            if name not in self.given:
                raise Refused(f"no value is given for @{name}")
            return self.given[name]
        if isinstance(node, ast.List | ast.Tuple | ast.Set):
            return [self.value(x) for x in node.elts]
        raise Refused(f"not a value: {ast.unparse(node)}")

    def column(self, node: ast.AST) -> Column:
        if isinstance(node, ast.Name) and node.id not in self.values:
            name = self.columns.get(node.id, node.id)
            if name not in self.df.columns:
                raise Refused(f"no column {name}")
            return ref(name)
        if isinstance(node, ast.BoolOp):
            return reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(self.truth, node.values))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.truth(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and not isinstance(node.operand, ast.Constant):
            return -self.column(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
            return ARITHMETIC[type(node.op)](self.column(node.left), self.column(node.right))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mod | ast.FloorDiv):  # the sign of the divisor, as in Python
            a, b = self.column(node.left), self.column(node.right)
            return a - b * F.floor(a / b) if isinstance(node.op, ast.Mod) else F.floor(a / b)
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            return reduce(operator.and_, [self.compared(a, op, b) for a, op, b in zip(sides[:-1], node.ops, sides[1:], strict=True)])
        return F.lit(self.value(node))

    def truth(self, node: ast.AST) -> Column:
        """A predicate without a third value: what can't be told is false."""
        return F.coalesce(self.column(node).cast("boolean"), F.lit(False))

    def compared(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Column:
        if isinstance(op, ast.Eq | ast.NotEq | ast.In | ast.NotIn) and isinstance(right, ast.List | ast.Tuple | ast.Set) or isinstance(op, ast.In | ast.NotIn):
            wanted = self.value(right)
            if isinstance(wanted, str) or not hasattr(wanted, "__iter__"):
                raise Refused(f"not a list: {ast.unparse(right)}")
            wanted, own = list(wanted), self.column(left)
            some = [w for w in wanted if w is not None]
            held = own.isin(some) if some else F.lit(False)
            held = F.coalesce(held, F.lit(False)) | (own.isNull() if len(some) < len(wanted) else F.lit(False))
            return ~held if isinstance(op, ast.NotEq | ast.NotIn) else held
        a, b = self.column(left), self.column(right)
        if isinstance(op, ast.Eq):
            return a == b
        if isinstance(op, ast.NotEq):  # a missing value differs from everything, itself included
            return F.coalesce(a != b, F.lit(True))
        if type(op) in COMPARISONS:
            return COMPARISONS[type(op)](a, b)
        raise Refused(f"unknown comparison: {type(op).__name__}")


def predicate(df: DataFrame, text: str, given: Mapping[str, object] | None = None) -> Column:
    """The rows' predicate that a criteria text is. Missing values compare false (with != true), and in finds None."""
    source, columns, values = _python(text)
    try:
        tree = ast.parse(source.strip(), mode="eval").body
    except SyntaxError as e:
        raise Refused(f"not a predicate: {text}") from e
    if not isinstance(tree, ast.Compare | ast.BoolOp | ast.UnaryOp | ast.Name | ast.Constant):
        raise Refused(f"not a predicate: {text}")
    translator = _Translator(df, columns, values, given or {})
    if isinstance(tree, ast.Compare):  # as it is, so that the scan can take it over
        return translator.column(tree)
    if isinstance(tree, ast.BoolOp) and isinstance(tree.op, ast.And) and all(isinstance(x, ast.Compare) for x in tree.values):
        return reduce(operator.and_, map(translator.column, tree.values))
    return translator.truth(tree)
