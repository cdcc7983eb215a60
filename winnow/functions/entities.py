"""Entities in text: patterns, weights and their extraction as arrays of (etype, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, word lists and weights that define the entity types.
URL = r"""https?://[^\s<>"'`\])]+"""
PATH = r"(?<!:/)(?<!//)(?:[./~])?(?:/[\w.\-]+){2,}"
PORT = r"(?:(?:[Pp]ort|PORT)[= ]+(\d{2,5}))|(?::(\d{2,5})(?:[/\s,\)]|$))"
HTTP_STATUS = (
    r"\b((?:1|2|3|4|5)\d{2})\b(?:\s+(?:Unauthorized|Forbidden|Not Found|Internal Server Error|Bad Request|OK|Created"
    r"|Accepted|No Content|Bad Gateway|Service Unavailable|Gateway Timeout|error|Error|ERROR))"
)
EXCEPTION = r"\b([A-Z][a-zA-Z]*(?:Error|Exception|Warning|Fault))\b"
FUNCTION = r"\b([a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)*)\s*\("
CLASS_NAME = r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"
PACKAGE = (
    r"(?:pip install|pip3 install|npm install|yarn add|pacman -S|yay -S|cargo install|gem install|go install)"
    r"\s+([a-zA-Z][a-zA-Z0-9_\-]{1,})"
)
COMMAND = (
    r"(?:^|\$\s+)((?:git|docker|npm|pip|python|node|cargo|make|curl|wget|ssh|scp|rsync|kubectl|uv|hyprctl|systemctl)"
    r"\s+[a-z][a-z0-9_\- ]{2,40})"
)
ENV_VAR = r"\b([A-Z][A-Z0-9_]{2,})(?:=|\b)"
SKIPPED_FUNCTIONS = (
    "print", "len", "str", "int", "list", "dict", "set", "type", "range", "open", "super", "self", "init", "main", "test",
    "run", "get", "put", "post",
)
SKIPPED_ENV_VARS = (
    "HOME", "PATH", "USER", "SHELL", "PWD", "TRUE", "FALSE", "NULL", "NONE", "TODO", "NOTE", "WARN", "INFO", "DEBUG",
    "ERROR", "PASS", "FAIL", "TYPE", "NAME", "FILE", "DATA", "TEST", "SELF", "ARGS", "KWARGS", "ALSO", "WITH", "FROM",
    "THEN", "WHEN", "THAT", "THIS", "WILL", "HAVE", "BEEN", "DOES", "WHAT", "EACH", "SOME", "ONLY", "JUST", "MORE",
    "MOST", "VERY", "INTO", "OVER", "SUCH", "THAN", "THEM", "THESE", "THOSE", "AFTER", "BEFORE", "BETWEEN", "SHOULD",
)
ENV_PREFIXES = ("CUDA", "OPENROUTER", "SIGNAL", "DOCKER", "KUBECONFIG", "PYTHONPATH", "NODE", "RUST", "CARGO", "GOPATH")
WEIGHTS = {
    "file_path": 1.0, "error": 1.0, "exception": 0.9, "url": 0.8, "port": 0.8, "command": 0.7, "package": 0.7,
    "function": 0.5, "class_name": 0.4, "env_var": 0.4, "http_status": 0.6,
}
OTHER_WEIGHT = 0.3
# End of fixed values.

#: Unicode classes, and lines that end at \n alone.
_FLAGS = "(?Ud)"
_ENDS = r"[.,;:)]+$"


def weight(etype: Column) -> Column:
    """The weight of an entity type, as a constant expression: no join is needed for eleven numbers."""
    pairs = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(pairs, etype), F.lit(OTHER_WEIGHT))


def _all(text: Column, pattern: str, group: int, flags: str = _FLAGS) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def found(text: Column) -> dict[str, Column]:
    """An array of raw matches for each type."""
    trimmed = lambda x: F.regexp_replace(x, _ENDS, "")
    masked = F.regexp_replace(text, r"""(?U)(https?:)//[^\s<>"'`\])]+""", "$1 ")
    number = lambda x: x.try_cast("int")
    ports = F.concat(_all(text, PORT, 1), _all(text, PORT, 2))
    return {
        "url": F.transform(_all(text, URL, 0), trimmed),
        "file_path": F.transform(_all(masked, PATH, 0), trimmed),
        "port": F.filter(ports, lambda x: number(x).between(80, 99) | number(x).between(1024, 65535)),
        "http_status": _all(text, HTTP_STATUS, 1),
        "exception": _all(text, EXCEPTION, 1),
        "function": F.filter(_all(text, FUNCTION, 1), lambda x: (F.length(x) >= 4) & ~x.isin(*SKIPPED_FUNCTIONS)),
        "class_name": _all(text, CLASS_NAME, 1),
        "package": _all(text, PACKAGE, 1),
        "command": _all(text, COMMAND, 1, "(?mUd)"),
        "env_var": F.filter(
            _all(text, ENV_VAR, 1),
            lambda x: (F.length(x) >= 4) & ~x.isin(*SKIPPED_ENV_VARS) & (x.contains("_") | x.rlike("^(" + "|".join(ENV_PREFIXES) + ")")),
        ),
    }


def entity_array(text: Column) -> Column:
    """Distinct (etype, value) of a text: values stripped, in lower case, of two characters at least. Null text: none."""

    def named(etype: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(etype).alias("etype"), x.alias("value"))

    parts = []
    for etype, values in found(F.coalesce(text, F.lit(""))).items():
        clean = F.transform(values, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
        kept = F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 2))
        parts.append(F.transform(kept, named(etype)))
    return F.concat(*parts)


def explode_entities(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, etype, value: one row for each distinct entity of each row's text; all types in one projection."""
    # matching is what costs: spread it over all partitions, where a small shuffle before has been merged into few
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.select(*keys, text).repartition(n, *keys)
    return spread.select(*keys, F.explode(entity_array(F.col(text))).alias("_e")).select(*keys, "_e.etype", "_e.value")
