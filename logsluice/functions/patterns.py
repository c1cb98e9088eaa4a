"""Regular expressions in the dialect shared by Java and Python.

The expected results are defined with ASCII word boundaries, ``\\s`` without the vertical tab,
``.`` that stops only at a line feed and ``$`` that means the very end. None of those are
Java's defaults, so they are spelled out here.
"""

WORD = "[0-9A-Za-z_]"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACE = r"[\t\n\f\r ]"
NON_SPACE = r"[^\t\n\f\r ]"
# Whitespace of the wider kind used when splitting text into tokens.
TOKEN_GAP = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def any_case(*words: str) -> str:
    """Case-insensitive alternation that also folds the long s and the Kelvin sign."""
    folded = (w.replace("s", "[s\u017f]").replace("k", "[k\u212a]") for w in words)
    return "(?i:" + "|".join(folded) + ")"


# --- terminal codes and time stamps (fixed values) ---
ANSI = "\x1b(?:\\[[0-?]*[ -/]*[@-~]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\))"
LOOSE_STAMP = r"^[0-9]{4}-[0-9][0-9]-[0-9][0-9][T ][0-9:.]+(?:Z|[+-][0-9][0-9]:[0-9][0-9])?[ \t]"
TRANSPORT_STAMP = (
    r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])T(?:[01]?[0-9]|2[0-3])"
    r":[0-5][0-9]:[0-5][0-9](?:[.,][0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-4]):(?:[0-5][0-9]|60))\z"
)

# --- framing (fixed values: what continues a multi-line event) ---
CONTINUATION = (
    rf"^(?:{SPACE}+{NON_SPACE}|Caused by:|Suppressed:|Traceback |[0-9A-Za-z_.]+(?:Error|Exception):"
    rf"|{SPACE}*\.\.\. [0-9]+ more)"
)
STACK_MARK = (
    rf"^{SPACE}*(?:at{SPACE}+{NON_SPACE}|File [\"']|Caused by:|Suppressed:|Traceback "
    r"|[0-9A-Za-z_.]+(?:Error|Exception):|\.\.\. [0-9]+ more)"
)
PYTHON_FRAME = rf"^{SPACE}*File [\"'][^\n]+[\"'], line [0-9]+(?:, in [^\n]+)?\z"
CARET_LINE = rf"^{SPACE}+[~^]+[~^ ]*\z"
DOTNET_LINE = (
    rf"^{SPACE}+--- End of (?:inner exception stack trace|stack trace from previous location) ---\z"
)
LEVEL_LINE = (
    rf"^{SPACE}*"
    + any_case("trace", "debug", "info", "notice", "warn", "warning", "error", "fatal", "critical")
    + NOT_BEFORE_WORD
)
GO_HEADER = r"^goroutine [0-9]+ \[[^\n]+\]:\z"
GO_FRAME = (
    r"^(?:[0-9A-Za-z_./-]+\.(?:\([^ )]+\)\.)?[0-9A-Za-z_.$]+\([^\n]*\)"
    rf"|{SPACE}+{NON_SPACE}+\.go:[0-9]+(?: \+0x[0-9a-f]+)?"
    rf"|created by {NON_SPACE}+ in goroutine [0-9]+)\z"
)
GO_START = r"^(?:panic|fatal error): "
KEY_MARK = r"-----(BEGIN|END) (?:[A-Z0-9]+ )*PRIVATE KEY-----"

# --- redaction (fixed values: which names and shapes are secret) ---
SECRET_FIELD = any_case(
    "password", "passwd", "secret", "token", "authorization", "cookie", "api[-_]?key",
    "access[-_]?key", "private[-_]?key", "credential",
)
SECRET_PAIR = (
    "([\"']?"
    + any_case(
        "password", "passwd", "secret", "(?:access_|refresh_)?token", "api[-_]?key",
        "access[-_]?key(?:[-_]?id)?", "private[-_]?key", "authorization", "cookie", "credentials?",
    )
    + rf"[\"']?{SPACE}*[:=]{SPACE}*)"
    + r"(?:\"(?:\\[^\n]|[^\"\\\n])*+\"|'(?:\\[^\n]|[^'\\\n])*+'|[^\t\n\f\r ,;]+)"
)
AUTH_SCHEME = (
    f"{NOT_AFTER_WORD}(" + any_case("bearer", "basic") + rf"){SPACE}+[A-Za-z0-9._~+/=-]+"
)
URL_LOGIN = (
    rf"({NOT_AFTER_WORD}[a-zA-Z][a-zA-Z0-9+.-]{{0,31}}://)"
    r"[^\t\n\f\r /@:]+:[^\t\n\f\r /@]+@"
)
WEB_TOKEN = rf"{NOT_AFTER_WORD}eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+{EDGE}"
REDACTED = "[REDACTED]"
KEY_BLOCK_TEXT = "[REDACTED PRIVATE KEY]"
DEEP_JSON_TEXT = "[REDACTED JSON: nesting limit]"

# --- baseline signals (fixed values) ---
RISK_WORDS = (
    NOT_AFTER_WORD
    + any_case("error", "fatal", "panic", "exception", "critical", "oomkilled", "out of memory",
               "crashloopbackoff")
    + NOT_BEFORE_WORD
)
WARN_WORDS = NOT_AFTER_WORD + any_case("warn", "warning") + NOT_BEFORE_WORD
SERVER_FAULT = (
    rf"(?:{any_case('status')}[\"\t\n\f\r :=]+|(?i:http/)[0-9](?:\.[0-9])?[\"\t\n\f\r ]+)"
    rf"5[0-9][0-9]{NOT_BEFORE_WORD}"
)
SECURITY_WORDS = any_case(
    "auth", "credential", "password", "permission", "privilege", "security", "fraud", "attack",
    "denied", "forbidden", "token", "secret", "payment", "role",
)

# --- templates (fixed values) ---
PROTECTED_WORDS = (
    "status", "code", "level", "error", "auth", "role", "security", "fraud", "permission",
    "success", "fail", "result", "outcome", "severity", "payment", "amount", "balance", "backup",
    "bytes", "count", "denied", "permit", "privilege", "access", "allow", "grant", "acl",
    "response", "password", "secret", "token", "credential", "cookie", "deny", "category",
    "importance", "operation", "messagekind", "duration", "latency", "identity", "tenant",
    "username",
)
# Names are compared without their separators, so only ASCII letters count.
PROTECTED_NAME = "(?i:" + "|".join(PROTECTED_WORDS) + ")"


def protected_inside(stop: str) -> str:
    """A protected word anywhere before ``stop``, with separators allowed between its letters."""
    gap = f"[^a-zA-Z0-9{stop}]*"
    return f"[^{stop}]*(?i:" + "|".join(gap.join(w) for w in PROTECTED_WORDS) + ")"


OPAQUE_BODY = (
    "(?:[0-9a-fA-F]{16,64}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})"
)
ID_NAME_BODY = any_case(
    "request[_-]?id", "trace[_-]?id", "span[_-]?id", "correlation[_-]?id", "session[_-]?id",
)
# A number, an address, a time of day.
VARIABLE_BODY = (
    r"(?:[+-]?[0-9]+(?:\.[0-9]+)?|[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?)"
)
