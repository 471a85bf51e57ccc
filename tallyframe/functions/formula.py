"""Formulas as text, compiled to Columns when a plan is made.

A formula has names, numbers, + - * /, parentheses and COALESCE(name, default). COALESCE gives its default for 0 as well
as for null. A name that the frame lacks makes a formula void (null everywhere); a plain field that is null counts as 0; a
virtual field that couldn't be resolved is null, and so is the formula. Division by 0 is null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import ratio

OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: ratio}


class Formula:
    """A parsed formula: what it reads, and its Column over a frame."""

    def __init__(self, text: str):
        self.text = text
        self.tree = ast.parse(text.replace("d&a", "d_and_a").strip(), mode="eval").body
        self.required: list[str] = []  # names outside COALESCE
        self.optional: list[str] = []
        self._walk(self.tree)

    def _walk(self, node: ast.AST) -> None:
        if isinstance(node, ast.Name):
            self.required.append(node.id)
        elif isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            self._walk(node.left)
            self._walk(node.right)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            self._walk(node.operand)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "COALESCE" and len(node.args) == 2 and isinstance(node.args[0], ast.Name):
            self.optional.append(node.args[0].id)
            if isinstance(node.args[1], ast.Name):
                self.optional.append(node.args[1].id)
            elif not isinstance(node.args[1], ast.Constant):
                raise ValueError(f"COALESCE takes a name or number as default: {self.text}")
        elif not (isinstance(node, ast.Constant) and isinstance(node.value, int | float)):
            raise ValueError(f"not a formula: {self.text}")

    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.required, *self.optional]))

    def column(self, present: Iterable[str], virtual: Iterable[str] = ()) -> Column:
        """Over a frame with these columns, of which `virtual` are resolved ones."""
        present, virtual = set(present), set(virtual)
        if any(n not in present for n in self.required):
            return F.lit(None).cast("double")

        def field(name: str) -> Column:
            c = F.col(name).cast("double")
            return c if name in virtual else F.coalesce(c, F.lit(0.0))

        def build(node: ast.AST) -> Column:
            if isinstance(node, ast.Constant):
                return F.lit(float(node.value))
            if isinstance(node, ast.Name):
                return field(node.id)
            if isinstance(node, ast.UnaryOp):
                return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
            if isinstance(node, ast.Call):
                default = build(node.args[1])
                if node.args[0].id not in present:
                    return default
                c = F.col(node.args[0].id).cast("double")
                return F.when(c.isNotNull() & (c != 0), c).otherwise(default)
            return OPERATORS[type(node.op)](build(node.left), build(node.right))

        return build(self.tree)

    def guarded(self, present: Iterable[str], virtual: Iterable[str] = ()) -> Column:
        """As column(), but null also where a name outside COALESCE is null."""
        present = set(present)
        out = self.column(present, virtual)
        for name in dict.fromkeys(self.required):
            if name in present:
                out = F.when(F.col(name).isNotNull(), out)
        return out


def ordered(fields: dict[str, list[str]]) -> list[str]:
    """Names of virtual fields so that each comes after those that it reads."""
    out: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            return  # a field may name itself's user; the later one reads what is there then
        for text in fields[name]:
            for other in Formula(text).names():
                if other in fields and other not in out and other != name:
                    visit(other, (*above, name))
        if name not in out:
            out.append(name)

    for name in fields:
        visit(name, ())
    return out


def with_virtual_fields(df: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """df with a column for each virtual field: the first of its formulas that has all it needs."""
    present, done = set(df.columns), []
    for name in [n for n in ordered(fields) if n.replace("d&a", "d_and_a") not in present]:
        clean = name.replace("d&a", "d_and_a")
        df = df.withColumn(clean, F.coalesce(*(Formula(t).guarded(present, done) for t in fields[name])))
        present.add(clean)
        done.append(clean)
    return df


def macro(text: str) -> str | None:
    """The field of YOY_GROWTH(field), else None."""
    found = re.fullmatch(r"\s*YOY_GROWTH\((\w+)\)\s*", text)
    return found[1] if found else None
