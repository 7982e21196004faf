"""Text functions that are sequential by nature (X18, X22, X32, S17–S21, S27, G15), in Arrow batches.

Each is a plain Python function on one value, and ``apply`` runs it over a column without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


PART = 50_000  # rows of an output batch


def apply(df: DataFrame, keep: list[str], text: str, fn: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """``keep`` columns and the rows ``fn`` gives for each non-NULL ``text``. ``schema``: DDL of fn's fields."""
    source = df.select(*keep, text).where(f"`{text}` is not null")
    out = StructType.fromDDL(schema)
    full = StructType(source.schema.fields[: len(keep)] + out.fields)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    names = [f.name for f in full.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [], [[] for _ in kinds]

            def made(batch=batch) -> pa.RecordBatch:
                kept = [batch.column(n).take(pa.array(at, pa.int64())) for n in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

            for k, value in enumerate(batch.column(len(keep))):
                for row in fn(value.as_py()):  # fn may be a generator: rows leave in parts, however many there are
                    at.append(k)
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                    if len(at) >= PART:
                        yield made()
                        at.clear()
                        for col in cols:
                            col.clear()
            yield made()

    return source.mapInArrow(run, full)


# ---------------------------------------------------------------- X18

_OPEN, _CLOSE = "(<[{", ")>]}"


def split_arguments(raw: str) -> list[str]:
    """Arguments at the top nesting level, trimmed; an empty list has none. ``->`` does not close anything."""
    parts, depth, start = [], 0, 0
    for k, ch in enumerate(raw):
        if ch in _OPEN:
            depth += 1
        elif ch in _CLOSE and not (ch == ">" and raw[k - 1: k] == "-"):
            depth = max(0, depth - 1)
        elif ch == "," and depth == 0:
            parts.append(raw[start:k].strip())
            start = k + 1
    return [p for p in [*parts, raw[start:].strip()] if p]


def call_arguments(source: str, line: int, callee: str, reach: int = 8) -> list[str] | None:
    """Arguments of the call of ``callee`` whose line is nearest to ``line`` (of equals the earlier), at most
    ``reach`` lines away; without a line (0) of the first call. Comments and literals hold no calls; the list of
    arguments may go over several lines. None if there is no such call, or if it never closes."""
    flat = _blanked(source)
    short = re.escape(callee.rsplit("::", 1)[-1])
    calls = []
    for m in re.finditer(rf"(?<!\w){short}\s*\(", flat):
        here = flat.count("\n", 0, m.start()) + 1
        calls.append((abs(here - line) if line else 0, m.start(), m.end()))
    for far, _, begin in sorted(calls):
        if far > reach:
            break
        depth = 1
        for k in range(begin, len(flat)):
            depth += flat[k] == "("
            depth -= flat[k] == ")"
            if not depth:
                return [" ".join(a.split()) for a in _cut(source[begin:k], flat[begin:k])]
    return None


def _cut(raw: str, flat: str) -> list[str]:
    """As ``split_arguments``, with the commas taken from the text whose literals are blank."""
    parts, depth, start = [], 0, 0
    for k, ch in enumerate(flat):
        if ch in _OPEN:
            depth += 1
        elif ch in _CLOSE and not (ch == ">" and flat[k - 1: k] == "-"):
            depth = max(0, depth - 1)
        elif ch == "," and depth == 0:
            parts.append(raw[start:k])
            start = k + 1
    return [p for p in map(str.strip, [*parts, raw[start:]]) if p]


# ---------------------------------------------------------------- X22

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})


def _balanced(text: str) -> Iterator[str]:
    """Outermost balanced objects and arrays, then what an unfinished last one would be, closed."""
    at = 0
    while at < len(text):
        if text[at] not in "{[":
            at += 1
            continue
        stack, quoted, skip = [], False, False
        for k in range(at, len(text)):
            c = text[k]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = c == "\\", c != '"'
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
                if not stack:
                    yield text[at: k + 1]
                    break
        else:
            rest = text[at:] + ('"' if quoted else "")
            yield re.sub(r"[,:]\s*$", "", rest) + "".join(reversed(stack))
            return
        at = k + 1


def extract_json(text: str, required: str | None = None, kind: str = "object") -> tuple[str | None, str]:
    """(canonical JSON, actions joined by commas) of the first value of the wanted kind that has the required key.

    Tried in order: fenced blocks, then values inside prose; each as it is, then repaired: typographic
    quotes, control characters, lone backslashes, trailing commas, missing ends.
    """
    blocks = [(m.group(1), ["fence"]) for m in _FENCE.finditer(text)] + [(text, [])]
    for block, notes in blocks:
        for candidate in _balanced(block.translate(_QUOTES)):
            actions = list(notes)
            if candidate not in block:
                actions.append("quotes_or_end")
            for name, fix in (
                ("", lambda x: x), ("control", lambda x: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x)),
                ("backslash", lambda x: re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", x)), ("comma", lambda x: re.sub(r",(\s*[\]}])", r"\1", x)),
            ):
                fixed = fix(candidate)
                if fixed != candidate:
                    actions.append(name)
                candidate = fixed
                try:
                    value = json.loads(candidate, strict=False)
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict if kind == "object" else list) and (required is None or required in value):
                    return json.dumps(value, ensure_ascii=False, sort_keys=True), ",".join(actions)
                break
    return None, "none"


# ---------------------------------------------------------------- X32

_CLAIM = re.compile(r"\b([A-Za-z_]\w*(?:::\w+)*)\s*\(")
_KEYWORDS = frozenset("if for while switch return sizeof catch defined".split())


def callee_claims(text: str, reach: int = 80) -> list[tuple[str, int, str]]:
    """(name, position, window) of each call a text mentions, with ``reach`` characters on either side."""
    return [
        (m.group(1), m.start(), text[max(0, m.start() - reach): m.end() + reach]) for m in _CLAIM.finditer(text) if m.group(1) not in _KEYWORDS
    ]


# ---------------------------------------------------------------- S17, S18, S20, S21

_HEAD = re.compile(r"^[ \t]*((?:[A-Za-z_][\w:<>,*&\s]*?[\s*&])?)([A-Za-z_~][\w:~]*)\s*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*(?:const\s*)?\{", re.M)
_STRIP = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


def _blanked(source: str) -> str:
    """Comments and literals replaced by blanks of the same length; line ends stay."""
    return _STRIP.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def functions_in(source: str) -> list[tuple[str, str, int, int]]:
    """(name, signature, first line, last line) of every function body, by matching braces."""
    flat, out = _blanked(source), []
    for m in _HEAD.finditer(flat):
        if m.group(2) in _KEYWORDS or m.group(2) == "else":
            continue
        depth, end = 1, len(flat)
        for k in range(m.end(), len(flat)):
            depth += (flat[k] == "{") - (flat[k] == "}")
            if depth == 0:
                end = k
                break
        signature = " ".join(source[m.start(): m.end() - 1].split())
        out.append((m.group(2), signature, flat.count("\n", 0, m.start(2)) + 1, flat.count("\n", 0, end) + 1))
    return out


_CLASS = re.compile(r"\b(?:class|struct)\s+([A-Za-z_]\w*)\s*(?::\s*([^{;]+))?\{")


def classes_in(source: str) -> list[tuple[str, str]]:
    """(class, base) of every class or struct; base is '' for those without one."""
    out = []
    for m in _CLASS.finditer(_blanked(source)):
        bases = [re.sub(r"\b(?:public|private|protected|virtual)\b", "", b).strip() for b in (m.group(2) or "").split(",")]
        out += [(m.group(1), b) for b in bases]
    return out


def calls_in(source: str) -> list[tuple[str, int]]:
    """Distinct (callee, line) of a source text."""
    flat = _blanked(source)
    heads = {m.start(2) for m in _HEAD.finditer(flat)}
    found = {(m.group(1), flat.count("\n", 0, m.start()) + 1) for m in _CLAIM.finditer(flat) if m.group(1) not in _KEYWORDS and m.start() not in heads}
    return sorted(found, key=lambda x: (x[1], x[0]))


# ---------------------------------------------------------------- S23, S27

# fixed values: headings that open a callee table, names of its function column
CALLEE_HEADINGS = ("函数调用", "跟入", "跟进", "callee", "接收此污点", "传播目标", "子函数")
PARAMETER_COLUMNS = ("参数", "污点参数", "param", "params", "tainted_params")
NO_PARAMETERS = ("无", "none", "n/a", "-", "no")
STANDARD_LIBRARY = frozenset(
    "memcpy memmove memset memcmp strcpy strncpy strlen strcmp strncmp strcat strncat strdup strchr strstr sprintf snprintf printf fprintf malloc calloc realloc free "
    "exit abort assert fopen fclose fread fwrite read write open close".split()
)
FUNCTION_COLUMNS = ("函数名", "函数调用", "调用函数", "function", "func", "func_name", "callee")


def callee_table(text: str) -> list[tuple[str, str, str]]:
    """(callee, parameters, cells) of markdown tables under a callee heading; ``cells`` are all cells by column name
    as JSON. Rows marked ❌ or 否, rows of the standard library and rows whose parameters say none do not count.
    Parameters stand in a column of their own or in parentheses behind the callee."""
    out, inside, header = [], False, []
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("#"):
            inside, header = any(h in s.lower() for h in CALLEE_HEADINGS), []
        elif inside and s.startswith("|"):
            cells = [c.strip().strip("`") for c in s.strip("|").split("|")]
            if all(re.fullmatch(r":?-+:?", c) for c in cells):
                continue
            if not header:
                header = cells if any(c.lower() in FUNCTION_COLUMNS for c in cells) else []
                continue
            row = dict(zip(header, cells, strict=False))
            said = next(v for k, v in row.items() if k.lower() in FUNCTION_COLUMNS)
            name = re.match(r"([A-Za-z_][\w:>.\-]*)\s*(?:\(([^)]*)\))?", said)
            if not name or any(c in ("❌", "否") for c in cells) or name.group(1).rsplit("::", 1)[-1] in STANDARD_LIBRARY:
                continue
            params = next((v for k, v in row.items() if k.lower() in PARAMETER_COLUMNS), None)
            params = (name.group(2) or "").strip() if params is None else params
            if params.lower() not in NO_PARAMETERS:
                out.append((name.group(1), params, json.dumps(row, ensure_ascii=False)))
    return out


def tainted_list(text: str) -> list[tuple[str, str]]:
    """(function, variable) of a ``###``-delimited list with ``@taintvar`` lines; # begins a comment; functions of
    the standard library do not count."""
    out = []
    for block in text.split("###"):
        lines = [x.split("#", 1)[0].strip() for x in block.splitlines()]
        names = [x for x in lines if x and not x.startswith("@")]
        owner = names[0] if names else ""
        out += [(owner, v) for x in lines if x.startswith("@taintvar") and owner not in STANDARD_LIBRARY for v in x.split()[1:2]]
    return out


# ---------------------------------------------------------------- X38, X39

# fixed values: headings of reviews and words of their answers
REVIEW_HEADINGS = {
    "score": ("评分", "score"), "pass": ("通过", "pass"), "feedback": ("评审意见", "feedback"), "refinement": ("改进指令", "refinement"),
    "best": ("最佳worker", "bestworker", "best_worker"), "overall": ("整体通过", "overallpass", "overallpassed", "overall_passed"), "reasoning": ("对比理由", "理由", "reasoning"),
}
YES, NO = ("是", "true", "yes", "pass"), ("否", "false", "no", "fail")
BEST_WORDS = "最优|最好|胜出|best|winner"
PASS_SCORE, LOOSE_PASS_SCORE, EXCERPT = 60, 70, 500


def _review_sections(text: str) -> dict[str, tuple[str, str]]:
    """Field -> (text on the heading's line, text below it) of the markdown headings a review uses; the first of each counts."""
    known = {alias: field for field, names in REVIEW_HEADINGS.items() for alias in names}
    out: dict[str, tuple[str, str]] = {}
    current, below = None, []

    def close() -> None:
        if current and current[0] not in out:
            out[current[0]] = (current[1], "\n".join(below).strip())

    for line in text.split("\n"):
        if line.startswith("##"):
            close()
            name, _, said = line.lstrip("#").replace("：", ":").replace("=", ":").partition(":")
            field = known.get("".join(name.split()).lower())
            current, below = (field, said.strip()) if field else None, []
        else:
            below.append(line)
    close()
    return out


def _said(text: str) -> bool | None:
    word = re.match(r"\w+", text.lower())
    return True if word and word.group() in YES else False if word and word.group() in NO else None


def review(text: str) -> tuple[bool, int, str, str]:
    """(pass, score, feedback, refinement) of a review: from its headings if they give a score, else from a JSON object
    with the key pass, else from "NN/100" or "NN分". Parts in <think> do not count."""
    bare = re.sub(r"(?s)<think>.*?</think>", "", text).strip()
    part = _review_sections(bare)
    number = re.match(r"\d+", part.get("score", ("", ""))[0])
    score = min(int(number.group()), 100) if number else 0
    if score:
        said = _said(part.get("pass", ("", ""))[0])
        return score >= PASS_SCORE if said is None else said, score, part.get("feedback", ("", ""))[1] or bare[:EXCERPT], part.get("refinement", ("", ""))[1]
    found, _ = extract_json(bare, "pass")
    if found:
        obj = json.loads(found)
        try:
            score = int(obj.get("score") or 0)
        except (TypeError, ValueError):
            score = 0
        return bool(obj["pass"]), score, str(obj.get("feedback") or ""), str(obj.get("refinement") or "")
    loose = re.search(r"(\d{1,3})\s*/\s*100|\b(\d{2,3})分", bare)
    score = int(loose.group(1) or loose.group(2)) if loose else 0
    return score >= LOOSE_PASS_SCORE, score, bare[:EXCERPT], ""


def verdict_summary(text: str) -> tuple[str, bool, str]:
    """(best worker, overall passed, reasoning) of a comparison: from its headings, else from a JSON object with the key
    best_worker, else from a worker named beside a word of praise."""
    part = _review_sections(text)
    overall = bool(_said(part.get("overall", ("", ""))[0]))
    best = re.match(r"worker-\d+", part.get("best", ("", ""))[0])
    if best:
        return best.group(), overall, part.get("reasoning", ("", ""))[1] or text[:EXCERPT]
    found, _ = extract_json(text, "best_worker")
    if found:
        obj = json.loads(found)
        return str(obj["best_worker"]), bool(obj.get("overall_passed", obj.get("pass", False))), str(obj.get("reasoning") or "")
    named = re.search(rf"(?i)(worker-\d+)\s*(?:{BEST_WORDS})", text) or re.search(rf"(?i)(?:{BEST_WORDS})[^\n]*?(worker-\d+)", text)
    return named.group(1) if named else "", overall, text[:EXCERPT]


# ---------------------------------------------------------------- G15


def forked_paths(steps: list[dict]) -> Iterator[list[str]]:
    """Paths through ordered steps {line, group, arm, targets}: arms of a group with two or more arms exclude
    each other, a step with several targets forks, one without targets is left out. Paths come one by one."""
    arms: dict[str, dict[str, list[dict]]] = {}
    for s in steps:
        if s["group"]:
            arms.setdefault(s["group"], {}).setdefault(s["arm"], []).append(s)
    slots: list[list[list[str]]] = []
    placed = set()
    for s in sorted(steps, key=lambda x: x["line"]):
        group = s["group"]
        if group and len(arms[group]) > 1:
            if group not in placed:
                placed.add(group)
                slots.append([[t for x in arm for t in x["targets"][:1]] for arm in arms[group].values()])
        elif s["targets"]:
            slots.append([[t] for t in s["targets"]])

    def walk(k: int, path: list[str]) -> Iterator[list[str]]:
        if k == len(slots):
            yield path
        else:
            for option in slots[k]:
                yield from walk(k + 1, path + option)

    return walk(0, [])
