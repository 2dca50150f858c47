"""Security rules over single lines: each returns a struct(severity, description, line_text) or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ENV_REFERENCE = r"process\.env|os\.environ|System\.getenv|ENV\[|getenv\("

#: (name, pattern with the value in group 1, severity)
SECRETS = [
    ("AWS Access Key ID", r"(AKIA[0-9A-Z]{16})", "high"),
    ("GitHub access token", r"(gh[pousr]_[A-Za-z0-9]{36,})", "high"),
    ("Slack token", r"(xox[baprs]-[0-9A-Za-z-]{10,72})", "high"),
    ("Private key block", r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)", "high"),
    (
        "Hardcoded credential assignment",
        r"""(?i)(?:(?:api|secret)[_-]?key|(?:access|auth)[_-]?token|client[_-]?secret)\s*[:=]\s*['"]([A-Za-z0-9_\-/+=]{16,})['"]""",
        "medium",
    ),
]
#: Any of them, to leave out the lines that none can match.
ANY_SECRET = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else p for _, p, _ in SECRETS)
PLACEHOLDERS = r"(?i)^(change[_-]?me|your[_-]?api[_-]?key|xxx+|placeholder|example|dummy|fake|test|todo|secret|password|redacted|null|undefined)$"


def _clean(line: Column) -> Column:
    return F.substring(F.trim(line, F.lit(" \t\r")), 1, 200)


def is_placeholder(value: Column) -> Column:
    return (
        value.rlike(PLACEHOLDERS)
        | (value.startswith("<") & value.endswith(">"))
        | (value.startswith("${") & value.endswith("}"))
        | value.rlike(r"^(.)\1{5,}$")
    )


def mask(value: Column) -> Column:
    n = F.length(value)
    stars = F.repeat(F.lit("*"), F.least(F.lit(20), n - 5))
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 3), stars, F.right(value, F.lit(2))))


def _masked_line(line: Column, pattern: str, value: Column) -> Column:
    """The line with the value masked where the match has it."""
    match = F.regexp_extract(line, pattern, 0)
    at = F.position(match, line)
    start = F.position(value, line, at)
    return _clean(F.concat(F.substr(line, F.lit(1), start - 1), mask(value), F.substr(line, start + F.length(value))))


def _finding(severity: str, description: str, text: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(description).alias("description"), text.alias("line_text"))


def secret(line: Column) -> Column:
    """First rule whose match is no placeholder; lines that read the environment are exempt."""
    out = F.when(line.rlike(ENV_REFERENCE), F.lit(None))
    for name, pattern, severity in SECRETS:
        value = F.regexp_extract(line, pattern, 1)
        text = _masked_line(line, pattern, value)
        out = out.when((value != "") & ~is_placeholder(value), _finding(severity, f"Possible {name} in source; keep credentials outside of the repository.", text))
    return out


_EVAL = (r"\beval\s*\(", "medium", "eval() runs a string as code.")
_JS = [_EVAL, (r"\bnew\s+Function\s*\(", "medium", "The Function constructor compiles a string to code.")]
#: language -> [(pattern, severity, description)]; the first that fits counts
EXECUTION: dict[str, list[tuple[str, str, str]]] = {
    "python": [
        _EVAL,
        (r"\bexec\s*\(", "medium", "exec() runs a string as code."),
        (r"\bos\.system\s*\(", "high", "os.system() hands a string to the shell."),
        (r"\bsubprocess\.(?:call|run|Popen|check_call|check_output)\([^)]*shell\s*=\s*True", "high", "shell=True hands the command to the shell."),
        (r"\bpickle\.loads?\s*\(", "medium", "Unpickling untrusted data can run code."),
    ],
    "javascript": _JS,
    "typescript": _JS,
    "php": [_EVAL, (r"\b(?:system|exec|passthru|shell_exec|popen)\s*\(", "high", "Runs a shell command.")],
    "ruby": [_EVAL, (r"\bsystem\s*\(", "high", "system() runs a command in a subshell.")],
    "lua": [(r"\b(?:loadstring|load)\s*\(", "medium", "loadstring()/load() compiles a string to code.")],
}


def dynamic_execution(language: Column, line: Column) -> Column:
    out = F
    for lang, rules in EXECUTION.items():
        for pattern, severity, description in rules:
            out = out.when((language == lang) & line.rlike(pattern), _finding(severity, description, _clean(line)))
    return out


CHILD_PROCESS_IMPORT = r"""require\(\s*['"]child_process['"]\s*\)|from\s+['"]child_process['"]"""
_DYNAMIC_EXEC = r"\b(?:exec|execSync)\s*\([^)]*(?:\+|\$\{)"


def child_process(line: Column) -> Column:
    return F.when(line.rlike(_DYNAMIC_EXEC), _finding("high", "exec()/execSync() with a command built from parts; pass an argument array.", _clean(line)))


_VERB = r"\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b"
SQL_RULES = [
    (r"(?i)`[^`]*" + _VERB + r"[^`]*\$\{[^}]+\}[^`]*`", "SQL built with a template literal."),
    (r"(?i)f['\"][^'\"]*" + _VERB + r"[^'\"]*\{[^}]+\}[^'\"]*['\"]", "SQL built with an f-string."),
    (r"(?i)['\"][^'\"]*" + _VERB + r"[^'\"]*['\"]\s*\+", "SQL built by concatenation."),
    (r"(?i)['\"][^'\"]*" + _VERB + r"[^'\"]*['\"]\s*%\s*\S", "SQL built by % formatting."),
]


def sql_injection(line: Column) -> Column:
    return reduce(lambda out, r: out.when(line.rlike(r[0]), _finding("high", r[1] + " Use a parameterised query.", _clean(line))), SQL_RULES, F)
