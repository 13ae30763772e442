"""Windows paths: where one ends depends on quotes, known extensions and the words before it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import Pattern, jvm

# Fixed values.
START = r"\b(?=([A-Za-z]:\\[^\r\n]*))[A-Za-z]:\\"
EXTENSION = r"(?i)^.*?\.(?:ps1|psm1|psd1|txt|csv|log|json|xml|ini|config|conf|yaml|yml|exe|msi|dll|zip|bat|cmd)\b(?=[ \t,)\]}]|\z)"
CONTEXT = r"""(?i)\b(?:source|destination|target|input|output|path|file|folder|directory|root|script|profile|install|log)(?:[ _-]?(?:path|file|folder|directory))?\b[ \t]*[:=][ \t]*["']?\z"""


def whole(m: Column) -> Column:
    """The path that begins with the match; extra is the rest of its line. Labels count within what a match knows of its line."""
    before, rest = F.regexp_extract(m["before"], r"[^\n]*\z", 0), m["extra"]
    quote = F.right(before, F.lit(1))
    bare = F.regexp_replace(F.regexp_extract(rest, r"""^[^"'<>|?*;]*""", 0), r"[ \t]+\$[A-Za-z_][A-Za-z0-9_]*[ \t]*=.*|[ \t]+\z", "")
    named = F.regexp_extract(bare, jvm(EXTENSION), 0)
    ended = F.when(~bare.rlike(r"[ \t]"), bare).when(named != "", named).when(before.rlike(jvm(CONTEXT)), bare).otherwise(F.regexp_extract(bare, r"^[^ \t]*", 0))
    return F.when(quote == '"', F.substring_index(rest, '"', 1)).when(quote == "'", F.substring_index(rest, "'", 1)).otherwise(F.regexp_replace(ended, r"[ \t,)\]}]+\z", ""))


WINDOWS = Pattern(START, cut=whole, gate=(":\\",), extra=1, test=lambda m: F.length(m["value"]) > 3)
