"""Arithmetic formulas over columns, compiled from a checked syntax tree to one column expression."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import divide, round_half_even, strict_number

_FUNCTIONS: dict[str, Callable] = {
    "abs": F.abs, "min": F.least, "max": F.greatest, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "exp": F.exp,
    "log": lambda x: F.when(x > 0, F.log(x)), "log10": lambda x: F.when(x > 0, F.log10(x)), "log2": lambda x: F.when(x > 0, F.log2(x)),
    "round": lambda x, n=None: round_half_even(x, n or 0),
}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: divide, ast.FloorDiv: lambda a, b: F.floor(divide(a, b)).cast("double"), ast.Mod: lambda a, b: F.when(b != 0, a - F.floor(a / b) * b), ast.Pow: F.pow}


def compile_formula(formula: str, resolve: Callable[[str], Column], digits: int | None = None) -> Column:
    """``{name}`` stands for a column's strict number.  Anything but arithmetic is refused."""
    names: list[str] = []

    def slot(m: re.Match) -> str:
        names.append(m[1].strip())
        return f"_c{len(names) - 1}"

    tree = ast.parse(re.sub(r"\{([^{}]+)\}", slot, formula), mode="eval")

    def build(node: ast.AST):
        match node:
            case ast.Expression(body=b):
                return build(b)
            case ast.Constant(value=bool()):
                raise ValueError("only numbers are allowed")
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=i) if re.fullmatch(r"_c[0-9]+", i):
                return strict_number(resolve(names[int(i[2:])]))
            case ast.UnaryOp(op=ast.USub(), operand=o):
                return -build(o)
            case ast.UnaryOp(op=ast.UAdd(), operand=o):
                return build(o)
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a), build(b))
            case ast.Call(func=ast.Name(id="round"), args=[x, ast.Constant(value=int() as n)], keywords=[]):
                return round_half_even(build(x), n)
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _FUNCTIONS:
                return _FUNCTIONS[f](*map(build, args))
        raise ValueError(f"not allowed in a formula: {ast.dump(node)[:80]}")

    out = build(tree)
    return out if digits is None else round_half_even(out, digits)
