"""The rule catalogue, and its compilation into one array expression a line."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule of any type; pattern rules report every match, scan rules a line once."""

    id: str
    severity: str
    pattern: str = ""
    title: str = ""
    type: str = "pattern"
    metric: str | None = None
    max_value: int | None = None
    ast_check: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    enabled: bool = True


# Identifiers, severities and patterns of the built-in rules.
SECRET_RULES = (
    Rule("SEC001", "critical", r"(?:AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}", "cloud access key"),
    Rule("SEC002", "critical", r"(?i)aws[_\-]?secret[_\-]?access[_\-]?key\s*[=:]\s*['\"]?([A-Za-z0-9/+=]{40})['\"]?", "cloud secret"),
    Rule("SEC003", "critical", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}", "code host token"),
    Rule("SEC004", "high", r"(?i)(?:api[_\-]?key|apikey|secret[_\-]?key|access[_\-]?token|auth[_\-]?token)\s*[=:]\s*['\"][A-Za-z0-9\-_./+=]{16,}['\"]", "key in an assignment"),
    Rule("SEC005", "critical", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "private key"),
    Rule("SEC006", "high", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "signed token"),
    Rule("SEC007", "critical", r"xox[bporas]-[0-9]{10,}-[A-Za-z0-9-]+", "chat token"),
    Rule("SEC008", "high", r"(?i)(?:postgres|mysql|mongodb|redis|mssql)://[^\s'\"]{10,}", "database address"),
    Rule("SEC009", "high", r"(?i)(?:password|passwd|pwd)\s*[=:]\s*['\"][^'\"]{6,}['\"]", "password"),
    Rule("SEC010", "high", r"AIza[0-9A-Za-z\-_]{35}", "search company key"),
    Rule("SEC011", "critical", r"(?:sk|pk)_(?:live|test)_[A-Za-z0-9]{20,}", "payment key"),
    Rule("SEC012", "critical", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", "mail service key"),
)
VULNERABILITY_RULES = (
    Rule("VLN001", "high", r"(?i)(?:execute|cursor\.execute|raw|rawsql)\s*\(\s*(?:f['\"]|['\"].*%s|.*\.format\()", "SQL from input"),
    Rule("VLN002", "high", r"(?i)(?:os\.system|os\.popen|subprocess\.call|subprocess\.run|subprocess\.Popen)\s*\(\s*(?:f['\"]|.*\.format\(|.*%\s)", "command from input"),
    Rule("VLN003", "high", r"(?i)(?:pickle\.loads?|yaml\.load\s*\([^)]*(?!Loader))", "unsafe loading"),
    Rule("VLN004", "medium", r"(?<!\w)(?:eval|exec)\s*\(", "dynamic evaluation"),
    Rule("VLN005", "medium", r"(?i)verify\s*=\s*False", "TLS check off"),
    Rule("VLN006", "medium", r"(?i)(?:hashlib\.(?:md5|sha1)|\.(?:md5|sha1)\s*\()", "weak digest"),
    Rule("VLN007", "low", r"(?:0\.0\.0\.0|127\.0\.0\.1):\d{2,5}", "fixed address"),
    Rule("VLN008", "medium", r"(?i)(?:debug\s*=\s*True|DEBUG\s*=\s*True|app\.run\(.*debug\s*=\s*True)", "debug mode"),
    Rule("VLN009", "medium", r"(?i)(?:access-control-allow-origin['\": ]*\*|allow_origins\s*=\s*\[?\s*['\"]\*['\"])", "open origins"),
    Rule("VLN010", "low", r"(?<!\w)random\.(?:random|randint|choice|randrange)\s*\(", "weak random source"),
    Rule("VLN011", "medium", r"(?:innerHTML|dangerouslySetInnerHTML|v-html)\s*[=:]", "raw markup"),
    Rule("VLN012", "medium", r"(?:__proto__|constructor\s*\[|Object\.assign\s*\(\s*\{\s*\})", "prototype pollution"),
)
FILE_RULES = (
    Rule("FIL001", "high", r"(?i)\.env(?:\.local|\.prod|\.staging)?$", "environment file"),
    Rule("FIL002", "critical", r"(?i)(?:id_rsa|id_ed25519|id_ecdsa)(?:\.pub)?$", "login key file"),
    Rule("FIL003", "high", r"(?i)\.(?:pem|key|p12|pfx|jks|keystore)$", "certificate file"),
    Rule("FIL004", "high", r"(?i)(?:credentials|secrets|passwords)\.(?:json|yml|yaml|xml|txt)$", "credentials file"),
)
DEFAULT_IGNORE = (r"\.lock$", r"package-lock\.json$", r"yarn\.lock$", r"go\.sum$", r"\.min\.(js|css)$", r"dist/", r"node_modules/", r"vendor/", r"__pycache__/", r"\.generated\.")
AST_RULES = {"no-eval": "high", "no-exec": "high", "no-star-import": "medium", "no-mutable-default": "medium", "no-bare-except": "medium", "no-global": "low"}
METRICS = ("cyclomatic", "nesting", "length", "cognitive", "params", "max_nesting")


def java(pattern: str) -> str:
    """The pattern with Unicode classes, as the rules' own language has them."""
    return "(?U)" + pattern


def ignored(path: Column, patterns: Sequence[str] | None = None) -> Column:
    """Whether any pattern is found in a path; no list or an empty one means the default."""
    return path.rlike("|".join(f"(?:{p})" for p in (patterns or DEFAULT_IGNORE)))


def in_scope(path: Column, rule: Rule) -> Column:
    inside = path.rlike("|".join(f"(?:{java(p)})" for p in rule.include)) if rule.include else F.lit(True)
    return inside & ~path.rlike("|".join(f"(?:{java(p)})" for p in rule.exclude)) if rule.exclude else inside


def any_of(rules: Sequence[Rule]) -> str:
    """One expression that is found where any of the rules' is; what it is not found in need not be read again."""
    return "(?U)" + "|".join(f"(?:{r.pattern})" for r in rules)


def hits(line: Column, rules: Sequence[Rule]) -> Column:
    """array<struct<rule_id, severity>> of the rules found in a line, in their order: a projection, no join."""
    found = F.array(*[F.when(line.rlike(java(r.pattern)), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"))) for r in rules])
    return F.filter(found, lambda x: x.isNotNull())


def matches(line: Column, rules: Sequence[Rule], path: Column) -> Column:
    """array<struct<rule_id, severity, match>>: every match of every pattern rule in scope."""
    none = F.array().cast("array<struct<rule_id:string,severity:string,match:string>>")

    def of(r: Rule) -> Column:
        found = F.transform(F.regexp_extract_all(line, F.lit(java(r.pattern)), F.lit(0)), lambda m: F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), m.alias("match")))
        return F.when(in_scope(path, r), found).otherwise(none)

    each = [of(r) for r in rules if r.enabled and r.type == "pattern" and r.pattern]
    return F.flatten(F.array(*each)) if each else none


def validate(rules: Sequence[Rule], spark: SparkSession | None = None) -> list[tuple[str, str, str]]:
    """(rule, field, message) of everything wrong with a list of rules.

    With a session patterns are tried in the JVM, which is where they run: a pattern that does not
    compile there would end a job, so it has to be found here.
    """
    wrong, seen = [], set()
    for r in rules:
        if r.id in seen:
            wrong.append((r.id, "id", "duplicate id"))
        seen.add(r.id)
        if r.type == "pattern":
            if not r.pattern:
                wrong.append((r.id, "pattern", "missing"))
            elif not compiles(r.pattern, spark):
                wrong.append((r.id, "pattern", "no regular expression"))
        elif r.type == "threshold":
            if not r.metric:
                wrong.append((r.id, "metric", "missing"))
            elif r.metric not in METRICS:
                wrong.append((r.id, "metric", "unknown"))
            if r.max_value is None:
                wrong.append((r.id, "max_value", "missing"))
        elif r.type == "ast":
            if not r.ast_check:
                wrong.append((r.id, "ast_check", "missing"))
            elif r.ast_check not in AST_RULES:
                wrong.append((r.id, "ast_check", "unknown"))
        if r.severity not in ("critical", "high", "medium", "low", "info"):
            wrong.append((r.id, "severity", "unknown"))
    return wrong


def compiles(pattern: str, spark: SparkSession | None = None) -> bool:
    try:
        re.compile(pattern)
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(java(pattern))
    except Exception:
        return False
    return True


def usable(rules: Sequence[Rule], spark: SparkSession) -> list[Rule]:
    """The rules whose patterns compile; the others are skipped, as validate() reports."""
    return [r for r in rules if r.type != "pattern" or (r.pattern and compiles(r.pattern, spark))]


# What a finding of a rule means and what to do about it, by the rule.
ADVICE = {
    "SEC": ("A secret stands in the text and is known to all who can read it.", "Revoke it, and read its successor from the environment or a vault."),
    "FIL": ("A file of this name usually holds secrets.", "Take it out of the repository and list it in the ignore file."),
    "VLN001": ("Input may become part of a database command.", "Bind parameters."),
    "VLN002": ("Input may become part of a system command.", "Pass a list of arguments without a shell."),
    "VLN003": ("Loading untrusted data this way can run code.", "Use a safe loader or another format."),
    "VLN004": ("Text is run as code.", "Parse literals, or call functions by name from a table."),
    "VLN005": ("The certificate of the other side is not checked.", "Leave the check on, with an own authority if need be."),
    "VLN006": ("The digest is broken.", "Use SHA-256 or later."),
    "VLN007": ("An address is fixed in the text.", "Take host and port from the configuration."),
    "VLN008": ("Debug mode shows inner state to users.", "Take it from the environment, off by default."),
    "VLN009": ("Every origin may read the answers.", "Name the origins that may."),
    "VLN010": ("The random source can be foreseen.", "Use a source made for secrets."),
    "VLN011": ("Markup is put into the page unchecked.", "Set text, or clean the markup."),
    "VLN012": ("Keys from input may change every object.", "Check keys, or use objects without a prototype."),
}


def described(findings: DataFrame) -> DataFrame:
    """Findings with title, description and suggestion of their rule (null for other rules), from map literals of fixed size."""
    known = (*SECRET_RULES, *VULNERABILITY_RULES, *FILE_RULES)
    text = lambda k: F.create_map(*[F.lit(x) for r in known for x in (r.id, (r.title, *ADVICE.get(r.id, ADVICE.get(r.id[:3], ("", ""))))[k])])
    rule = F.col("rule_id")
    return findings.withColumns({name: F.try_element_at(text(k), rule) for k, name in enumerate(("title", "description", "suggestion"))})
