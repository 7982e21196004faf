"""Scalar functions X01–X39 as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
SEVERITY_WORDS = {
    "critical": ("critical", "致命", "严重", "critical/high"), "high": ("high", "高危"), "medium": ("medium", "中危", "一般"), "low": ("low", "低危", "提示", "info"),
}
SEVERITY_LABELS = {"critical": "致命", "high": "严重", "medium": "一般", "low": "提示", "info": "提示", "unknown": "未知"}
METRIC_SUFFIXES = ("_bucket", "_sum", "_count", "_total")
OPERATION_ALIASES = {
    "return_value": "return", "call_argument": "call_arg", "argument": "call_arg", "arg": "call_arg", "indirect": "call_arg", "function_pointer": "call_arg",
    "dlsym": "call_arg", "dereference": "field", "field_write": "field", "field_read": "field", "member": "field", "log": "sink", "logging": "sink",
    "file": "sink", "path": "sink",
}
OPERATIONS = ("assignment", "call_arg", "return", "field", "container", "condition", "sink", "terminate", "validation", "sanitizer", "unknown")
SANITIZER_EFFECTS = ("none", "partial", "complete", "unknown")
# Words of error texts; all words of a group must occur, one of each tuple is enough.
ERROR_KINDS = (
    ("ScriptValidationFailed", (("script_validation_failed",),)), ("ForeignKeyConstraint", (("foreign key constraint failed",),)),
    ("RootFunctionAnalysisFailed", (("root function analysis failed",),)), ("NameError", (("name '",), ("is not defined",))),
    ("FileExistsError", (("[errno 17]", "file exists"),)), ("DirectoryNotEmptyError", (("[errno 39]", "directory not empty"),)), ("OSError", (("[errno",),)),
    ("ContextOverflow", (("context length", "input tokens"),)), ("AuthError", (("key authentication", "401"),)), ("NoModelError", (("no model",),)),
    ("NoModelError", (("model",), ("not found",))), ("TimeoutError", (("timeout", "timed out"),)), ("ConnectionError", (("connection",), ("refused", "reset", "unreachable"))),
)
ERROR_STAGES = (
    ("worker", (("worker", "taint"),)), ("round", (("round",),)), ("trace", (("trace",),)), ("vuln_mining", (("vuln", "mining"),)), ("orchestrator", (("orchestrat",),)), ("dispatch", (("dispatch", "lease"),)),
)
EXTERNAL_REASONS = (
    ("任务源文件/输入丢失", (("no such file", "not a directory", "源文件", "input_path", "does not exist", "找不到", "文件不存在", "invalid_input"),)),
    ("模型选择错误", (("model",), ("not found", "不可用", "no model", "无可用"))), ("API key 错误", (("401", "unauthorized", "invalid api key", "key authentication", "认证失败"),)), ("API key 错误", (("api key",), ("invalid", "无效"))),
    ("模型超时/不可达", (("timed out", "timeout", "http 000", "connection refused", "connection reset", "unreachable", "couldn't connect", "connection error"),)),
)
CPU_UNITS = {"n": 1e-6, "u": 1e-3, "m": 1.0, "": 1e3}
MEMORY_UNITS = {"Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40, "Pi": 2**50, "Ei": 2**60, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12, "P": 10**15, "E": 10**18, "": 1}
FAILURE_WORDS = (("cancel", ("cancel",)), ("timeout", ("timeout", "timed out", "deadline")), ("lease_lost", ("lease",)), ("validation", ("invalid", "validation")), ("error", ("error",)), ("failed", ("failed",)))
SINK_NAMES = (
    "memcpy", "strcpy", "strncpy", "sprintf", "snprintf", "vsprintf", "vsnprintf", "strcat", "strncat", "gets", "scanf", "sscanf", "fscanf", "fgets", "memmove", "bcopy",
    "read", "recv", "recvfrom", "recvmsg", "system", "popen", "execve", "execl", "execv", "execvp", "execlp", "malloc", "calloc", "realloc", "free", "strtok", "strtok_r", "strsep",
    "open", "creat", "openat", "ioctl", "setsockopt", "sendto", "sendmsg", "send", "write", "fwrite", "pwrite", "writev", "atoi", "atol", "strtol", "strtoul", "strtod",
    "sqlite3_exec", "mysql_query", "mysql_real_query",
)
FACT_WORDS = {
    "null_check": ("null", "nullptr", "非空", "空指针"), "range": ("range", "范围", "上限", "下限"), "bounds": ("bound", "bounds", "length", "len", "size", "越界", "边界", "长度"),
    "enum": ("enum", "whitelist", "白名单", "枚举"), "auth": ("auth", "permission", "owner", "权限", "授权", "归属"),
    "sanitizer": ("sanitize", "sanitizer", "clean", "canonical", "清洗", "净化", "转义"),
}
PARENT_SCOPE_SENTINEL = "__no_parent__"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def first_of(cases: list[tuple[Column, Column | str | None]], default: Column | str | None = None) -> Column:
    """Value of the first case whose condition holds."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """True if any of the words occurs in the text."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def lookup(values: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def short_id(*parts: Column | str, size: int = 16, sep: str = "\x1f") -> Column:
    """First hex digits of the SHA-1 of the parts joined by a separator; NULL parts count as ''."""
    return F.substring(F.sha1(F.concat_ws(sep, *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])), 1, size)


def signature_key(c: Column | str) -> Column:
    """All blanks removed, lower case."""
    return F.lower(F.regexp_replace(_c(c), "\\s+", ""))


def validation_signature(validations: Column) -> Column:
    """Sorted set of ``kind:target:summary`` tokens joined by ``|``. ``validations``: array of structs."""
    token = lambda v: F.concat_ws(":", F.lower(F.trim(v["kind"])), F.trim(v["target"]), signature_key(v["summary"]))
    return F.concat_ws("|", F.array_sort(F.array_distinct(F.transform(validations, token))))


def line_number(c: Column | str) -> Column:
    """First number in texts such as L588-590."""
    return F.nullif(F.regexp_extract(_c(c), "(\\d+)", 1), F.lit("")).cast("int")


def line_range(c: Column | str) -> Column:
    """struct(first, last) of 765, "765-767", [765] and [765, 767]; last is 0 for one line, both are 0 if unreadable."""
    shape = r"^\s*\[?\s*(\d+)\s*(?:[-,]\s*(\d+))?\s*\]?\s*$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(_c(c), shape, k), F.lit("")).cast("int"), F.lit(0))
    return F.struct(part(1).alias("first"), part(2).alias("last"))


def line_bucket(c: Column | str) -> Column:
    """Tens below the line; 289 and 290 differ."""
    return (F.floor(_c(c) / 10) * 10).cast("int")


def finding_id(function: Column | str, kind: Column | str, line: Column | str) -> Column:
    """Stable id of a finding by function, kind and line bucket."""
    return F.concat(F.lit("vuln_"), short_id(function, kind, line_bucket(line), sep="|"))


def severity(c: Column | str) -> Column:
    """One of four severities; unknown words are medium."""
    word = F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))
    return first_of([(word.isin(*words), name) for name, words in SEVERITY_WORDS.items()], "medium")


def severity_label(c: Column | str) -> Column:
    """Platform label of a severity."""
    word = F.lower(F.trim(F.coalesce(_c(c), F.lit(""))))
    return F.coalesce(lookup(SEVERITY_LABELS, word), F.nullif(word, F.lit("")), F.lit("未知"))


def confidence_percent(c: Column | str) -> Column:
    """0 to 100; fractions up to 1 are scaled, unreadable values are 60; halves round to even."""
    number = _c(c).try_cast("double")
    scaled = F.when(number <= 1, number * 100).otherwise(number)
    return F.when(number.isNull(), 60).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(scaled).cast("int"))))


def report_id(task: Column | str, *parts: Column | str) -> Column:
    """Report id from the task's tail and a digest of the identifying parts."""
    digest = F.upper(short_id(*parts, size=10, sep="|"))
    return F.concat(F.lit("DVS-"), F.substring(_c(task), -8, 8), F.lit("-"), digest)


def route_template(c: Column | str) -> Column:
    """Numeric, hex and uuid segments of a route as {id}."""
    raw = F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit("/"))
    return F.regexp_replace(raw, "(?i)/(?:\\d+|[0-9a-f]{8}-[0-9a-f-]{27,}|[0-9a-f]{8,})(?=/|$)", "/{id}")


def status_class(c: Column | str) -> Column:
    """2xx, 4xx …; negative is cancelled, 0 or unreadable counts as 500."""
    code = F.coalesce(F.nullif(_c(c).try_cast("int"), F.lit(0)), F.lit(500))
    return F.when(code < 0, "cancelled").otherwise(F.concat(F.floor(code / 100).cast("string"), F.lit("xx")))


def metric_family(c: Column | str) -> Column:
    """Metric name without the first matching suffix."""
    return F.regexp_replace(_c(c), "(?:" + "|".join(METRIC_SUFFIXES) + ")$", "")


def label_unescape(c: Column | str) -> Column:
    """Escaped backslash, quote and line end of a label value, read from left to right in one pass."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"(?s)(\\.|[^\\]+|\\$)"), F.lit(1))
    plain = F.transform(parts, lambda p: F.when(p == "\\n", "\n").when(p.isin("\\\\", '\\"'), F.substring(p, 2, 1)).otherwise(p))
    return F.array_join(plain, "")


def failure_class(status: Column | str, reason: Column | str) -> Column:
    """X11: first class whose words occur in status and reason."""
    text = F.lower(F.concat_ws(" ", F.coalesce(_c(status), F.lit("")), F.coalesce(_c(reason), F.lit(""))))
    return first_of([(any_word(text, words), name) for name, words in FAILURE_WORDS], "none")


def by_words(c: Column | str, rules: tuple) -> Column:
    """Name of the first rule all of whose word groups occur in the text, case aside; NULL if none fits."""
    e = F.lower(_c(c))

    def holds(groups: tuple) -> Column:
        out = F.lit(True)
        for words in groups:
            out = out & any_word(e, words)
        return out

    return first_of([(holds(groups), name) for name, groups in rules])


def error_kind(c: Column | str) -> Column:
    """Kind of an error text; NULL if nothing fits."""
    return by_words(c, ERROR_KINDS)


def error_stage(c: Column | str) -> Column:
    """Stage an error text points to."""
    return by_words(c, ERROR_STAGES)


def external_reason(c: Column | str) -> Column:
    """Why an error comes from outside; NULL for errors of the service itself."""
    return by_words(c, EXTERNAL_REASONS)


def abnormal_code(status: Column | str, message: Column | str) -> Column:
    """Code of an abnormal end; NULL for tasks that ended well or still run."""
    s, m = _c(status), F.lower(F.coalesce(_c(message), F.lit("")))
    return F.when(s.isin("failed", "error", "cancelled"), first_of([
        (s == "cancelled", "user_cancelled"), (any_word(m, ("lease", "租约")), "lease_lost"), (any_word(m, ("dispatch", "调度")), "dispatch_failed"),
        (any_word(m, ("timeout", "dependency")), "dependency_unavailable"), (s == "error", "unknown_abnormal"),
    ], "orchestration_failed"))


def operation(c: Column | str, valid: tuple[str, ...] = OPERATIONS) -> Column:
    """Operation word by alias; words that are neither alias nor valid are unknown."""
    word = F.lower(F.trim(F.coalesce(F.nullif(_c(c), F.lit("")), F.lit("unknown"))))
    return F.coalesce(lookup(OPERATION_ALIASES, word), F.when(word.isin(*valid), word), F.lit("unknown"))


def graph_edge(source: Column, target: Column, line: Column, evidence: Column, op: Column, effect: Column) -> Column:
    """An edge with its defaults filled in and the warnings of what was wrong: struct(from, to, line, evidence, operation,
    effect, warnings). A missing end of a sink or terminating edge is named after it."""
    text = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    made, word = operation(op), F.lower(F.trim(F.coalesce(effect.cast("string"), F.lit("none"))))
    missing = [F.when(text(c).isNull(), f"missing {name}") for name, c in (("from", source), ("to", target), ("line", line), ("evidence", evidence))]
    raw = F.coalesce(text(op), F.lit("unknown"))
    wrong = [F.when(~raw.isin(*OPERATIONS), F.concat(F.lit("unknown operation: "), raw)), F.when(~word.isin(*SANITIZER_EFFECTS), F.concat(F.lit("invalid sanitizer_effect: "), word))]
    return F.struct(
        F.coalesce(text(source), F.lit("unknown")).alias("from"), F.coalesce(text(target), F.when(made.isin("terminate", "sink"), made), F.lit("unknown")).alias("to"),
        F.coalesce(text(line), F.lit("unknown")).alias("line"), F.coalesce(text(evidence), F.lit("not provided")).alias("evidence"), made.alias("operation"),
        F.when(word.isin(*SANITIZER_EFFECTS), word).otherwise("unknown").alias("effect"), F.array_compact(F.array(*missing, *wrong)).alias("warnings"),
    )


def fact_kinds(c: Column | str) -> Column:
    """Kinds of validation facts a text states, in fixed order; ['unknown'] if none."""
    low = F.lower(_c(c))
    number = low.rlike("(<=|<|>=|>)\\s*-?\\d+")
    parts = [F.when(any_word(low, words) | (number if kind == "range" else F.lit(False)), kind) for kind, words in FACT_WORDS.items()]
    kinds = F.array_compact(F.array(*parts))
    return F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("unknown")))


def risk_rank(kinds: Column) -> Column:
    """100 none, 80 unknown, 10 only sanitizer, 40 validated, 60 otherwise."""
    has = lambda k: F.array_contains(kinds, k)
    checked = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in ("range", "bounds", "enum", "auth", "null_check")]))
    return first_of([
        (F.size(kinds) == 0, F.lit(100)), (has("no_validation"), F.lit(100)), (has("unknown"), F.lit(80)),
        (F.size(F.array_distinct(kinds)) == F.when(has("sanitizer"), 1).otherwise(-1), F.lit(10)), (checked, F.lit(40)),
    ], F.lit(60))


def facts_cover(existing: Column, incoming: Column) -> Column:
    """Every incoming fact is covered by an existing one of its kind and target; wider ranges cover
    narrower ones. Facts: array<struct<kind,target,op,bound>>. No existing facts cover everything."""
    def covers(e: Column, i: Column) -> Column:
        same = (e["kind"] == i["kind"]) & (e["target"] == i["target"])
        upper = e["op"].isin("<", "<=") & i["op"].isin("<", "<=") & (e["bound"] >= i["bound"])
        lower = e["op"].isin(">", ">=") & i["op"].isin(">", ">=") & (e["bound"] <= i["bound"])
        return F.coalesce(same & F.when(e["kind"] == "range", upper | lower).otherwise(e["op"].eqNullSafe(i["op"])), F.lit(False))

    every = F.forall(incoming, lambda i: F.exists(existing, lambda e: covers(e, i)))
    return first_of([(F.size(existing) == 0, F.lit(True)), (F.size(incoming) == 0, F.lit(False))], every)


def guard_range(guard: Column | str, symbol: Column | str) -> Column:
    """struct(op, bound) of the first comparison of ``symbol`` with a number; flipped if the number is first."""
    g, s = _c(guard), _c(symbol)
    quoted = F.concat(F.lit("\\Q"), s, F.lit("\\E"))
    ahead = F.concat(quoted, F.lit("\\s*(<=|<|>=|>)\\s*(-?\\d+)"))
    behind = F.concat(F.lit("(-?\\d+)\\s*(<=|<|>=|>)\\s*"), quoted)
    flip = lookup({"<": ">", "<=": ">=", ">": "<", ">=": "<="}, F.call_function("regexp_extract", g, behind, F.lit(2)))
    take = lambda rx, k: F.nullif(F.call_function("regexp_extract", g, rx, F.lit(k)), F.lit(""))
    op = F.coalesce(take(ahead, 1), flip)
    bound = F.coalesce(take(ahead, 2), take(behind, 1)).cast("long")
    return F.when(op.isNotNull(), F.struct(op.alias("op"), bound.alias("bound")))


def positional_signature(params: Column, args: Column) -> Column:
    """Tainted names as positions among the actual arguments, sorted and joined; unknown names stay."""
    clean = F.transform(args, lambda a: F.trim(F.regexp_replace(F.trim(a), "^&+", "")))

    def place(p: Column) -> Column:
        said = F.regexp_extract(F.lower(p), "(?:arg|param|参数|第)\\s*([0-9]+)", 1)
        at = F.array_position(clean, F.trim(p))
        return F.when(said != "", F.concat(F.lit("arg"), said.try_cast("int"))).when(at > 0, F.concat(F.lit("arg"), at)).otherwise(F.trim(p))

    joined = F.array_join(F.array_sort(F.array_distinct(F.transform(params, place))), ",")
    return F.when(F.size(params) > 0, joined).otherwise(F.lit("unknown"))


def formal_parameters(signature: Column | str) -> Column:
    """Names of the parameters in a signature's first parentheses; void and ... have none."""
    inner = F.regexp_extract(_c(signature), "\\((.*)\\)", 1)
    names = F.transform(F.split(inner, ","), lambda p: F.regexp_extract(p, "([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\])?\\s*$", 1))
    return F.filter(names, lambda n: ~n.isin("", "void"))


def formal_parameters_typed(signature: Column | str) -> Column:
    """X20, second variant: a parameter needs a type before its name."""
    inner = F.regexp_extract(_c(signature), "\\((.*)\\)", 1)
    names = F.transform(F.split(inner, ","), lambda p: F.regexp_extract(p, "[\\w>*&]\\s*[\\s*&]([A-Za-z_]\\w*)\\s*(?:\\[[^\\]]*\\])?\\s*$", 1))
    return F.filter(names, lambda n: n != "")


def formal_parameter_count(signature: Column | str) -> Column:
    """X20, third variant: number of parameters, whatever their names; (void) and () have none."""
    inner = F.trim(F.regexp_extract(_c(signature), "\\((.*)\\)", 1))
    return F.when(inner.isin("", "void"), 0).otherwise(F.size(F.split(inner, ",")))


def qualified_candidates(name: Column | str) -> Column:
    """A::B::f -> [A::B::f, B::f, f]."""
    parts = F.split(_c(name), "::")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "::"))


def name_tail(name: Column | str) -> Column:
    """Last part of a qualified name."""
    return F.element_at(F.split(_c(name), "::"), -1)


def preview(c: Column | str, cap: int = 240) -> Column:
    """Blanks collapsed, cut to ``cap`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(_c(c), F.lit("")), "\\s+", " "))
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)


def tagged_result(c: Column | str) -> Column:
    """Content of the first <result> element, trimmed; NULL without one."""
    return F.nullif(F.trim(F.regexp_extract(_c(c), "(?s)<result>(.*?)</result>", 1)), F.lit(""))


def session_descriptor(path: Column | str) -> Column:
    """struct(role, module, attempt, flow) that a session's path states."""
    stem = F.regexp_extract(_c(path), "([^/]+?)(?:\\.jsonl)?$", 1)
    deep = "^d(\\d{2})-(.+)-(taint|vuln|track-.+|fptrack-.+)$"
    kind = F.regexp_extract(stem, deep, 3)
    sub = F.regexp_extract(stem, "^(worker-\\d+)-taint-(.+)$", 2)
    judge = F.contains(_c(path), F.lit("/judges/"))
    role = first_of([
        (kind == "vuln", "vuln"), (kind.rlike("^(fp)?track"), "tracker"), (kind == "taint", "sub_worker"), (sub != "", "sub_worker"), (judge, "judge"),
    ], "worker")
    return F.struct(
        role.alias("role"), F.nullif(F.coalesce(F.nullif(F.regexp_extract(stem, deep, 2), F.lit("")), sub), F.lit("")).alias("module"),
        F.coalesce(F.regexp_extract(stem, deep, 1).try_cast("int"), F.when(judge, F.regexp_extract(_c(path), "round_(\\d+)", 1).try_cast("int"))).alias("attempt"),
        F.when(kind.isin("") & (sub == "") & ~judge, "worker").otherwise("parallel").alias("flow"),
    )


def session_status(status: Column | str, active: Column) -> Column:
    """Status of a session from the status of its round."""
    s = F.lower(F.trim(F.coalesce(_c(status), F.lit(""))))
    return first_of([(active, "running"), (s.isin("failed", "error", "cancelled", "invalid_input", "completed_limited"), "blocked")], "completed")


def _units(c: Column, units: dict[str, float]) -> Column:
    # an unreadable amount gives NULL
    amount = F.regexp_extract(c, "^\\s*([0-9.]*)", 1).try_cast("double")
    unit = F.regexp_extract(c, "^\\s*[0-9.]*([A-Za-z]*)\\s*$", 1)
    return F.floor(amount * lookup({k: float(v) for k, v in units.items()}, unit)).cast("long")


def cpu_millicores(c: Column | str) -> Column:
    """250m, 1.5, 3000000n … as millicores."""
    return _units(_c(c), CPU_UNITS)


def memory_bytes(c: Column | str) -> Column:
    """64Mi, 2G … as bytes."""
    return _units(_c(c), MEMORY_UNITS)


def safe_name(c: Column | str) -> Column:
    """Runs of characters outside letters, digits, dot, dash and underscore become one underscore."""
    return F.regexp_replace(_c(c), "[^A-Za-z0-9._-]+", "_")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """At least 0; 0 if either is missing."""
    a, b = (F.unix_micros(_c(x).cast("timestamp")) for x in (start, end))
    return F.coalesce(F.greatest(F.lit(0.0), (b - a) / 1_000_000), F.lit(0.0))


def epoch_iso(c: Column | str) -> Column:
    """Epoch seconds as ISO text in UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(_c(c))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def fingerprint(parts: dict[str, Column]) -> Column:
    """SHA-256 of the parts as JSON with sorted keys; NULL parts count as ''."""
    cells = [F.coalesce(parts[k].cast("string"), F.lit("")).alias(k) for k in sorted(parts)]
    return F.sha2(F.to_json(F.struct(*cells)), 256)


def internal_event(c: Column | str, public: dict[str, str]) -> Column:
    """The internal type of an event's public type (``public``: internal -> public); others stay as they are."""
    return F.coalesce(lookup({v: k for k, v in public.items()}, _c(c)), _c(c))


def budget_cut(c: Column | str, tokens: int) -> Column:
    """Text within a token budget of three characters a token."""
    return F.substring(_c(c), 1, tokens * 3)


def parent_scope(c: Column | str) -> Column:
    """Blank scope as the sentinel."""
    return F.coalesce(F.nullif(F.trim(_c(c)), F.lit("")), F.lit(PARENT_SCOPE_SENTINEL))


def metric_value(c: Column | str) -> Column:
    """A value with six decimals."""
    return F.format_string("%.6f", _c(c).cast("double"))


def label_escape(c: Column | str) -> Column:
    """Backslash, line end and quote of a label value escaped."""
    out = F.replace(_c(c), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def is_sink(name: Column | str) -> Column:
    """short name is one of the known sinks."""
    short = F.trim(F.regexp_replace(F.regexp_extract(name_tail(name), "^([^(]*)", 1), "^\\*+|\\*+$", ""))
    return short.isin(*SINK_NAMES)
