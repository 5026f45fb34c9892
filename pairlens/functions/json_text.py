"""Reading JSON texts of any depth, strictly: what isn't JSON raises ValueError."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is no JSON")


def parse(text: str, number: Callable[[str, bool], object]) -> object:
    """The value of a JSON text; ``number(text, whole)`` makes its numbers, NaN and infinities are refused.

    The usual parser recurses, so texts nested deeper than it can go are read
    by a stack instead, with the same result. The last of repeated keys counts.
    """
    try:
        return json.loads(text, parse_int=lambda s: number(s, True), parse_float=lambda s: number(s, False), parse_constant=_no_constant)
    except RecursionError:
        return _by_stack(text, number)


def _by_stack(text: str, number: Callable[[str, bool], object]) -> object:
    space = _SPACE.match
    stack: list = []  # open containers
    keys: list = []  # of each open object the key whose value comes next
    at = space(text, 0).end()
    while True:
        # a value begins here
        sign = text[at : at + 1]
        if sign == "{" or sign == "[":
            made: object = {} if sign == "{" else []
            at = space(text, at + 1).end()
            if text[at : at + 1] == ("}" if sign == "{" else "]"):
                value, at = made, at + 1
            else:
                stack.append(made)
                if sign == "{":
                    key, at = _key(text, at)
                    keys.append(key)
                continue
        elif sign == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            found = _NUMBER.match(text, at)
            if found:
                value, at = number(found[0], found[1] is None and found[2] is None), found.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError(f"no value at {at}")
                value, at = _WORDS[word], at + len(word)
        # the value is whole: it goes into its container, which may end after it
        while True:
            at = space(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError(f"more text at {at}")
                return value
            top, sign = stack[-1], text[at : at + 1]
            if isinstance(top, dict):
                top[keys[-1]] = value
                if sign == ",":
                    keys[-1], at = _key(text, space(text, at + 1).end())
                    break
                if sign != "}":
                    raise ValueError(f"no end of an object at {at}")
                keys.pop()
            else:
                top.append(value)
                if sign == ",":
                    at = space(text, at + 1).end()
                    break
                if sign != "]":
                    raise ValueError(f"no end of an array at {at}")
            value, at = stack.pop(), at + 1


def _key(text: str, at: int) -> tuple[str, int]:
    """An object's key and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no key at {at}")
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no value of a key at {at}")
    return key, _SPACE.match(text, at + 1).end()
