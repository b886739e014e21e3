"""Text cleaning: redaction, numeric extraction, length caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The secret patterns and their replacements.
SECRET_KEYS = "password|pwd|pass|secret|token|api_key|access_key"
ENCRYPTED_TOKEN = r"gAAAAA[A-Za-z0-9_\-=]+"
KEY_VALUE = rf"({SECRET_KEYS})\s*[:=]\s*[^\s,]+"
URL_PASSWORD = r"://([^:]+):([^@]+)@"
ENCRYPTED_MARK = "***ENCRYPTED_PASSWORD***"
REDACTED_MARK = "***REDACTED***"
CONFIG_MARK = "***ENCRYPTED***"
NUMBER_PATTERN = r"-?\d+(\.\d+)?"
# End of fixed values.

# Strict mode keeps the separator and the quotes and also sees JSON keys.
# Possessive loops: linear time and no deep recursion on long values.
_STRING_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_QUOTED = rf"""(({SECRET_KEYS})"?\s*[:=]\s*"){_STRING_BODY}(")"""
_UNQUOTED = rf"""(({SECRET_KEYS})"?\s*[:=]\s*)[^\s,"}}]+"""


def redact_text(text: Column, strict: bool = False) -> Column:
    """Mask encrypted tokens, ``key=value`` secrets and URL passwords, in this order.

    ``strict=False`` rewrites any ``key: value`` as ``key=***``; ``strict=True`` leaves
    the punctuation as it was. NULL stays NULL; other types are cast to text.
    """
    out = F.regexp_replace(text.cast("string"), "(?i)" + ENCRYPTED_TOKEN, ENCRYPTED_MARK)
    if strict:
        out = F.regexp_replace(out, "(?i)" + _QUOTED, f"$1{REDACTED_MARK}$3")
        out = F.regexp_replace(out, "(?i)" + _UNQUOTED, f"$1{REDACTED_MARK}")
    else:
        out = F.regexp_replace(out, "(?i)" + KEY_VALUE, f"$1={REDACTED_MARK}")
    return F.regexp_replace(out, "(?i)" + URL_PASSWORD, f"://$1:{REDACTED_MARK}@")


def redact_config(config: Column, key: str = "db_password") -> Column:
    """Replace the value of ``key`` in a JSON object, or add it when it is missing.

    Works on the text, so that unknown keys and nested values stay as they are.
    """
    value = rf'(?:"{_STRING_BODY}"|[^,}}\s]+)'
    found = rf'("{key}"\s*:\s*){value}'
    entry = f'"{key}":"{CONFIG_MARK}"'
    return (
        F.when(config.rlike(found), F.regexp_replace(config, found, f'$1"{CONFIG_MARK}"'))
        .when(config.rlike(r"^\s*\{\s*\}\s*$"), F.lit("{" + entry + "}"))
        .otherwise(F.regexp_replace(config, r"\}\s*$", f",{entry}}}"))
    )


def mixed_to_numeric(text: Column) -> Column:
    """First number in a text as a double; NULL when there is none."""
    return F.regexp_extract(text.cast("string"), NUMBER_PATTERN, 0).try_cast("double")


def truncate_text(text: Column, limit: int) -> Column:
    """Cap a text at ``limit`` characters (code points, not bytes)."""
    return F.substring(text.cast("string"), 1, limit)
