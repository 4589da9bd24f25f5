"""One regular expression for a set of literal strings."""

from itertools import groupby
from os.path import commonprefix


def escape(text: str) -> str:
    return "".join("\\" + c if c.isascii() and not c.isalnum() and c not in "_ " else c for c in text)


def _one_of(chars: list[str]) -> str:
    return escape(chars[0]) if len(chars) == 1 else "[" + "".join(map(escape, chars)) + "]"


def _branch(keys: list[str], start: int) -> tuple[str, int]:
    """Pattern for the tails of sorted distinct keys from `start` on, and its nesting."""
    if len(keys) == 1:
        return escape(keys[0][start:]), 0
    shared = len(commonprefix([keys[0], keys[-1]]))
    ends_here = len(keys[0]) == shared
    tails: dict[str, list[str]] = {}
    depth = 0
    for char, group in groupby(keys[1:] if ends_here else keys, key=lambda k: k[shared]):
        tail, nesting = _branch(list(group), shared + 1)
        tails.setdefault(tail, []).append(char)
        depth = max(depth, nesting + 1)
    # Characters that lead to the same tail share one alternative.
    options = [_one_of(chars) + tail for tail, chars in tails.items()]
    body = options[0] if len(options) == 1 and not ends_here else "(?:" + "|".join(options) + ")"
    return escape(keys[0][start:shared]) + body + ("?" if ends_here else ""), depth


def literal_pattern(keys) -> tuple[str, int]:
    """A pattern that matches, at any position, the longest of the non-empty `keys`
    that starts there, and how deep its groups nest."""
    keys = sorted(set(keys))
    first = sorted({k[0] for k in keys})
    pattern, depth = _branch(keys, 0)
    return f"(?=[{''.join(map(escape, first))}]){pattern}", depth
