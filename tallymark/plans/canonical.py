"""Canonical JSON of control objects, and their SHA-256. Keys in code-unit order, numbers as ECMAScript
prints them, nothing undefined or non-finite."""

from __future__ import annotations

import hashlib
import json
import math


def number(x: float) -> str:
    """A finite number as ECMAScript prints it: shortest digits, exponents from 1e21 and below 1e-6."""
    if isinstance(x, int) and abs(x) < 2**53:
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("canonical JSON has no non-finite numbers")
    if x == 0:
        return "0"
    sign, digits = ("-" if x < 0 else ""), repr(abs(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)
    figures = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    figures = figures.rstrip("0") or "0"
    n = len(figures)
    if 0 < point <= 21:
        body = figures + "0" * (point - n) if n <= point else f"{figures[:point]}.{figures[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + figures
    else:
        e = point - 1
        body = figures[0] + (f".{figures[1:]}" if n > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"
    return sign + body


def canonical(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    raise TypeError(f"canonical JSON has no {type(value).__name__}")


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode("utf-8", "surrogatepass")).hexdigest()
