"""The branch context of every call in a C source: which if, else, switch arm or case it stands in."""

from __future__ import annotations

import re

from lodestrand.functions.text import _KEYWORDS, _blanked

_WORD = re.compile(r"[A-Za-z_]\w*|[{}();:]")


def branch_contexts(source: str) -> list[tuple[str, int, str]]:
    """(callee, line, path) of each call; the path lists group/arm pairs from the outermost branch inwards.

    An if with its else branches is one group with the arms then, else1, else2 …; a switch is one group with
    one arm per case label. Statements without braces end their branch at the semicolon.
    """
    flat = _blanked(source)
    items = [(m.group(), m.start()) for m in _WORD.finditer(flat)]
    stack: list[list] = []  # [group, arm, closed by ('}' or ';'), depth of parentheses at its begin]
    out, groups, parens, k = [], 0, 0, 0
    pending: list | None = None
    last_if: list | None = None

    def skip_condition(k: int) -> int:
        depth = 0
        while k < len(items):
            depth += (items[k][0] == "(") - (items[k][0] == ")")
            k += 1
            if depth == 0:
                return k
        return k

    while k < len(items):
        word, at = items[k]
        if word == "if":
            if pending and pending[0] == "else":
                group, arm = pending[1], pending[2]
            else:
                groups += 1
                group, arm = groups, "then"
            note(out, flat, items, k + 1, skip_condition(k + 1), stack)
            k = skip_condition(k + 1)
            pending = ["open", group, arm]
            continue
        if word == "else" and last_if:
            n = 1 if last_if[1] == "then" else int(last_if[1][4:]) + 1
            pending = ["else", last_if[0], f"else{n}"]
            k += 1
            if k < len(items) and items[k][0] == "if":
                continue
            pending[0] = "open"
            continue
        if word == "switch":
            groups += 1
            note(out, flat, items, k + 1, skip_condition(k + 1), stack)
            k = skip_condition(k + 1)
            pending = ["switch", groups, "head"]
            continue
        if word in ("case", "default") and stack and any(s[3] for s in stack):
            top = next(s for s in reversed(stack) if s[3])
            label = flat[at: flat.find(":", at)].strip()
            top[1] = " ".join(label.split())
            while k < len(items) and items[k][0] != ":":
                k += 1
        elif word == "{":
            stack.append([pending[1], pending[2], "}", pending[0] == "switch"] if pending else [None, "", "}", False])
            pending = None
        elif pending and pending[0] in ("open", "switch"):
            stack.append([pending[1], pending[2], ";", False])
            pending = None
            continue
        elif word in "};":
            if stack and stack[-1][2] == word:
                done = stack.pop()
                last_if = done[:2] if done[0] and not done[3] else None
                while stack and stack[-1][2] == ";" and word == "}":
                    last_if = stack.pop()[:2]
        elif word not in _KEYWORDS and word not in "():" and k + 1 < len(items) and items[k + 1][0] == "(":
            note(out, flat, items, k, k + 1, stack)
        k += 1
    return out


def note(out: list, flat: str, items: list, first: int, last: int, stack: list) -> None:
    """Calls among ``items[first:last]`` with the present branch path."""
    path = ">".join(f"{g}/{arm}" for g, arm, _, _ in stack if g)
    for k in range(first, last):
        word, at = items[k]
        if re.match(r"[A-Za-z_]", word) and word not in _KEYWORDS and k + 1 < len(items) and items[k + 1][0] == "(":
            out.append((word, flat.count("\n", 0, at) + 1, path))
