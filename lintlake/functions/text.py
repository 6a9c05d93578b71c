"""Text columns with the semantics of the scanned language's own string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def lines(text: Column) -> Column:
    """Lines at every kind of line end; the empty text has none, a closing line end opens none."""
    parts = F.split(text, _LINE_END)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """.ext of the last part, empty if there is none; a leading dot is no suffix."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def shortened(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def human_size(count: Column) -> Column:
    """Bytes in steps of 1024 with one decimal."""
    size, out = count.cast("double"), None
    for step, unit in enumerate(("B", "KB", "MB", "GB")):
        shown = F.format_string(f"%.1f {unit}", size / (1024.0**step))
        out = F.when(size < 1024.0 ** (step + 1), shown) if out is None else out.when(size < 1024.0 ** (step + 1), shown)
    return out.otherwise(F.format_string("%.1f TB", size / 1024.0**4))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def response_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws(":", model, prompt), 256)


def config_hash(config_json: Column) -> Column:
    """First 16 digits of the SHA-256 of a config's JSON with sorted keys."""
    return F.left(F.sha2(config_json, 256), F.lit(16))


def json_object(reply: Column) -> Column:
    """The first {...} of a model's reply, with or without a code fence around it."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))
