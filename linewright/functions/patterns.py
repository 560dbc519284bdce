"""Text shapes shared by the column expressions.

Everything here is a plain regular-expression string for the JVM regex engine.
Quantifiers are possessive wherever backing up could only lose (an optional
fraction, white space, a quoted JSON value): a match never backtracks over long
lines and never recurses per character, so one hostile line cannot overflow an
executor's stack.
"""

# The Unicode White_Space set, as a character class and its
# complement. Spark's trim functions and \s cover only part of it.
WS = r"[\p{Z}\t\n\x0B\f\r\x{85}]"
NOT_WS = r"[^\p{Z}\t\n\x0B\f\r\x{85}]"

# ASCII white space (what may follow a logcat or syslog stamp).
ASCII_WS = r"[ \t\n\f\r]"

# Month abbreviations.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"

HMS = "[0-9]{2}:[0-9]{2}:[0-9]{2}"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
FRACTION = r"(?:\.[0-9]+)?+"
ZONE = "(?:Z|[+-][0-9]{2}:[0-9]{2})?+"

LEADING_WS = f"^{WS}*+"
STAMP_END = rf"(?={ASCII_WS}|\z)"

# --- logcat: MM-DD HH:MM:SS.mmm ------------------------------------------
LOGCAT_STAMP = rf"[0-9]{{2}}-[0-9]{{2}} {HMS}\.[0-9]{{3}}"
LOGCAT_TS = f"{LEADING_WS}({LOGCAT_STAMP}){STAMP_END}"

# Third white-space separated field after the stamp, one letter long.
LOGCAT_LETTER = (
    f"{LEADING_WS}{LOGCAT_STAMP}{STAMP_END}"
    rf"{WS}*+{NOT_WS}++{WS}++{NOT_WS}++{WS}++([VDIWEF])(?={WS}|\z)"
)

# Fixed value: how a logcat section banner starts.
LOGCAT_BANNER = "--------- beginning"

# --- syslog: MMM DD HH:MM:SS, strict --------------------------------------
# A space-padded day needs something after the time; a two-digit day does not.
SYSLOG_STAMP = (
    f"{MONTH} (?:[0-9]{{2}} {HMS}{STAMP_END}| [0-9] {HMS}(?={ASCII_WS}))"
)
SYSLOG_TS = f"{LEADING_WS}({SYSLOG_STAMP})"
# The first ": " after the stamp and all that follows it.
SYSLOG_TAIL = f"(?s){LEADING_WS}{SYSLOG_STAMP}{WS}*+.*?(: .*)"

# --- plain text: four stamp shapes, told apart by their first characters ----
# The month shape is lenient about the day; with an unpadded one-digit day it
# wants one more character so that the whole line has at least 15 bytes.
_PLAIN_MONTH = (
    f"{MONTH} (?:[0-9]{{2}} {HMS}"
    rf"| [\x00-\x7F]?[0-9] {HMS}"
    rf"|[0-9] {HMS}(?=[\s\S]))"
)
PLAIN_TS = (
    f"{LEADING_WS}((?:{DATE}T{HMS}{FRACTION}{ZONE}"
    f"|{DATE} {HMS}{FRACTION}"
    f"|{_PLAIN_MONTH}"
    f"|{HMS}{FRACTION})(?![0-9A-Za-z]))"
)

# --- JSON lines -------------------------------------------------------------
JSON_START = rf"{LEADING_WS}[\{{\[]"

def up_to(limit: str) -> str:
    """Digit strings without superfluous zeros whose value is at most ``limit``."""
    shapes = [f"[0-9]{{1,{len(limit) - 1}}}(?![0-9])"]
    for i, digit in enumerate(limit):
        if digit != "0" and (i, digit) != (0, "1"):
            rest = len(limit) - i - 1
            shapes.append(f"{limit[:i]}[0-{int(digit) - 1}][0-9]{{{rest}}}(?![0-9])")
    return "(?:" + "|".join(shapes + [f"{limit}(?![0-9])"]) + ")"


# The largest unsigned 32-bit and 64-bit integers.
U32 = up_to("4294967295")
U64 = up_to("18446744073709551615")

# A level value that reads as an unsigned 32-bit integer, sign and zeros allowed.
# The quote is the one json_value leaves in front of string values.
JSON_UINT = rf'^"?{WS}*+\+?0*?({U32}){WS}*+\z'


def quoted(text: str) -> str:
    """``text`` as a literal inside a JVM regular expression."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


_JSON_TEXT = r'(?:[^"\\]++|\\.)*+'
_JSON_NUMBER = f"0*?{U64}"


def _json_lookup(keys, token: str, start: str) -> str:
    # The keys are tried in order. For each, the atomic group pins its first
    # occurrence in key position (after an opening brace or a comma, at any
    # depth); if no token follows that one's colon, the next key is tried and
    # later occurrences of this one are not.
    first_hits = "|".join(rf'(?>.*?[\{{,][ \t]*+"{quoted(key)}")' for key in keys)
    return rf"(?s){start}(?:{first_hits})[^:]*+:[ \t]*+{token}"


def json_text(*keys: str, start: str = "^") -> str:
    """Group 1: raw text of the first closed string value, without quotes."""
    return _json_lookup(keys, f'"({_JSON_TEXT})"', start)


def json_quoted(*keys: str, start: str = "^") -> str:
    """Group 1: as :func:`json_text`, with the opening quote kept."""
    return _json_lookup(keys, f'("{_JSON_TEXT}(?="))', start)


def json_number(*keys: str, start: str = "^") -> str:
    """Group 1: the leading digits of a bare number that fits 64 bits."""
    return _json_lookup(keys, f"({_JSON_NUMBER})", start)


def json_scalar(*keys: str, start: str = "^") -> str:
    """Group 1: a string with its opening quote, or the digits of a number."""
    return _json_lookup(keys, f'("{_JSON_TEXT}(?=")|{_JSON_NUMBER})', start)


# Lookups of a log line hold only for an object: first character ``{``.
OBJECT_START = rf"{LEADING_WS}(?=\{{)"
