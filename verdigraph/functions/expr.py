"""Formulas of parameters and scores: a small recursive-descent evaluator."""

from __future__ import annotations

import math
import re

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|(.))")
_ONE = {"abs": abs, "sqrt": lambda x: math.sqrt(x) if x >= 0 else math.nan, "exp": math.exp, "log": lambda x: _log(x), "ln": lambda x: _log(x)}
_TWO = {"min": min, "max": max}


class FormulaError(ValueError):
    """The text is no formula, or a variable has no value."""


def _log(x: float) -> float:
    return math.log(x) if x > 0 else (-math.inf if x == 0 else math.nan)


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


class _Parser:
    """+ and - bind least, then * and /, then a leading minus, then ^ (to the right)."""

    def __init__(self, text: str, values: dict[str, float] | None):
        self.values = None if values is None else {k.lower(): v for k, v in values.items()}
        self.names: list[str] = []
        self.tokens = [m.groups() for m in _TOKEN.finditer(text.strip()) if any(m.groups())]
        self.at = 0

    def _peek(self) -> str | None:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else None

    def _take(self, mark: str) -> bool:
        if self._peek() == mark:
            self.at += 1
            return True
        return False

    def whole(self) -> float:
        found = self.sum()
        if self.at < len(self.tokens):
            raise FormulaError("something is left over")
        return found

    def sum(self) -> float:
        found = self.product()
        while (op := self._peek()) in ("+", "-"):
            self.at += 1
            right = self.product()
            found = found + right if op == "+" else found - right
        return found

    def product(self) -> float:
        found = self.signed()
        while (op := self._peek()) in ("*", "/"):
            self.at += 1
            right = self.signed()
            found = found * right if op == "*" else _divide(found, right)
        return found

    def signed(self) -> float:
        if self._take("-"):
            return -self.signed()
        return self.signed() if self._take("+") else self.power()

    def power(self) -> float:
        base = self.primary()
        if self._take("^"):
            exponent = self.power()
            try:
                found = base**exponent
            except (OverflowError, ZeroDivisionError):
                return math.inf
            return math.nan if isinstance(found, complex) else found
        return base

    def primary(self) -> float:
        if self.at >= len(self.tokens):
            raise FormulaError("the formula ends too soon")
        number, name, mark = self.tokens[self.at]
        self.at += 1
        if number:
            return float(number)
        if name:
            return self._call(name.lower()) if self._peek() == "(" else self._value(name)
        if mark == "(":
            found = self.sum()
            if not self._take(")"):
                raise FormulaError("a parenthesis is open")
            return found
        raise FormulaError(f"{mark!r} is out of place")

    def _call(self, name: str) -> float:
        self.at += 1
        arguments = [self.sum()]
        while self._take(";") or self._take(","):
            arguments.append(self.sum())
        if not self._take(")"):
            raise FormulaError("a parenthesis is open")
        if name in _ONE and len(arguments) == 1:
            return _ONE[name](arguments[0])
        if name in _TWO and len(arguments) == 2:
            return _TWO[name](*arguments)
        raise FormulaError(f"no function {name} of {len(arguments)}")

    def _value(self, name: str) -> float:
        self.names.append(name)
        if self.values is None:
            return 1.0
        if name.lower() not in self.values:
            raise FormulaError(f"{name} has no value")
        return self.values[name.lower()]


def evaluate(text: str, values: dict[str, float] | None = None, decimal_comma: bool = False) -> float:
    return _Parser(text.replace(",", ".") if decimal_comma else text, values or {}).whole()


def identifiers(text: str) -> list[str]:
    """The variables that a formula names, in order."""
    parser = _Parser(text, None)
    parser.whole()
    return list(dict.fromkeys(parser.names))


def resolve(formulas: dict[str, str], known: dict[str, float]) -> dict[str, float]:
    """Values of formulas that may use each other, until nothing new resolves; the rest is left out."""
    values, open_ = {k.lower(): v for k, v in known.items()}, dict(formulas)
    while open_:
        done = {}
        for name, text in open_.items():
            try:
                done[name] = evaluate(text, values)
            except FormulaError:
                continue
        if not done:
            break
        values |= {k.lower(): v for k, v in done.items()}
        open_ = {k: v for k, v in open_.items() if k not in done}
    return values
