"""A bounded calculator: + - * / ** and a few functions on numbers and lists, 34 decimal digits, nothing else."""

from __future__ import annotations

import ast
from decimal import Decimal, localcontext

LONGEST = 400


def evaluate(text: str) -> Decimal:
    """The value of an expression; anything outside the language raises ValueError."""
    if len(text) > LONGEST:
        raise ValueError("the expression is too long")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"no expression: {e.msg}") from None
    with localcontext() as context:
        context.prec = 34
        value = _value(tree.body)
        if isinstance(value, list):
            raise ValueError("the result is a list")
        return +value


def _value(node: ast.AST):
    match node:
        case ast.Constant(value=bool()):
            raise ValueError("truth values are no numbers")
        case ast.Constant(value=int() | float()):
            return Decimal(str(node.value))
        case ast.UnaryOp(op=ast.USub()):
            return -_value(node.operand)
        case ast.List():
            return [_value(x) for x in node.elts]
        case ast.BinOp():
            a, b = _value(node.left), _value(node.right)
            match node.op:
                case ast.Add():
                    return a + b
                case ast.Sub():
                    return a - b
                case ast.Mult():
                    return a * b
                case ast.Div():
                    if b == 0:
                        raise ValueError("division by zero")
                    return a / b
                case ast.Pow():
                    if abs(b) > 1000:
                        raise ValueError("the exponent is too large")
                    return a**b
        case ast.Call(func=ast.Name(id=name), keywords=[]):
            args = [_value(x) for x in node.args]
            if name in ("min", "max"):
                return {"min": min, "max": max}[name](args[0] if len(args) == 1 and isinstance(args[0], list) else args)
            if name == "sum" and len(args) == 1:
                return sum(args[0], Decimal(0))
            if name == "dot" and len(args) == 2 and len(args[0]) == len(args[1]):
                return sum((x * y for x, y in zip(*args)), Decimal(0))
            if len(args) == 1 and isinstance(args[0], Decimal):
                if name == "sqrt" and args[0] >= 0:
                    return args[0].sqrt()
                if name == "log" and args[0] > 0:
                    return args[0].ln()
                if name == "exp" and abs(args[0]) < 1000:
                    return args[0].exp()
    raise ValueError("not part of the language")
