"""Dependencies from manifests, and their advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions.grades import cvss_severity, severity_rank
from lintlake.functions.text import basename, lines, strip

MANIFESTS = ("requirements.txt", "package.json", "go.mod")
OSV = "array<struct<id:string,summary:string,severity:array<struct<type:string,score:string>>,affected:array<struct<package:struct<name:string,ecosystem:string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>,references:array<struct<type:string,url:string>>,aliases:array<string>>>"
_PINNED = r"^([A-Za-z0-9_.-]+)\s*([><=!~]+)\s*(.+)"


def _requirement(line: Column) -> Column:
    """name and version of a line: only the first operator splits, extras and markers defeat or stay in the version."""
    pinned = line.rlike(_PINNED)
    bare = strip(F.substring_index(F.substring_index(line, ";", 1), "[", 1))
    return F.struct(F.when(pinned, F.regexp_extract(line, _PINNED, 1)).otherwise(bare).alias("name"), F.when(pinned, strip(F.regexp_extract(line, _PINNED, 3))).otherwise("*").alias("version"))


def requirements(content: Column) -> Column:
    kept = F.filter(F.transform(lines(content), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit("-")))
    return F.filter(F.transform(kept, _requirement), lambda d: d["name"] != "")


def package_json(content: Column) -> Column:
    """dependencies, then devDependencies; leading ^ and ~ go."""
    parsed = F.from_json(content, "dependencies map<string,string>, devDependencies map<string,string>")
    entries = lambda c: F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
    both = F.concat(entries(parsed["dependencies"]), entries(parsed["devDependencies"]))
    return F.transform(both, lambda e: F.struct(e["key"].alias("name"), F.regexp_replace(e["value"], r"^[\^~]+", "").alias("version")))


def go_mod(content: Column) -> Column:
    """Indented lines with a version."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\s+\S+\s+v[\d.]+\S*"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"(\S+)\s+(v[\d.]+\S*)\z", 1).alias("name"), F.regexp_extract(x, r"(\S+)\s+(v[\d.]+\S*)\z", 2).alias("version")))


def dependencies(manifests: DataFrame, *keys: str) -> DataFrame:
    """One row for each dependency of (keys, file, content), by the exact name of the manifest."""
    name = basename(F.col("file"))
    found = F.when(name == "requirements.txt", requirements(F.col("content"))).when(name == "package.json", package_json(F.col("content"))).when(name == "go.mod", go_mod(F.col("content")))
    ecosystem = F.when(name == "requirements.txt", "PyPI").when(name == "package.json", "npm").otherwise("Go")
    return manifests.where(name.isin(*MANIFESTS)).select(*keys, "file", ecosystem.alias("ecosystem"), F.explode(found).alias("d")).select(*keys, "file", "ecosystem", "d.name", "d.version")


def advisory_rows(advisories: DataFrame) -> DataFrame:
    """Advisories in the exchange format (column vulns, JSON text or OSV) to one row for each affected package."""
    parsed = advisories.select(F.explode(F.from_json("vulns", OSV) if dict(advisories.dtypes)["vulns"] == "string" else F.col("vulns")).alias("v"))
    events = F.flatten(F.flatten(F.transform(F.col("v.affected"), lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.try_element_at(F.filter(F.transform(events, lambda e: F.try_element_at(e, F.lit("fixed"))), lambda x: x.isNotNull()), F.lit(1))
    url = F.try_element_at(F.filter(F.transform(F.col("v.references"), lambda r: r["url"]), lambda x: x != ""), F.lit(1))
    score = F.try_element_at(F.col("v.severity"), F.lit(1))
    return parsed.select(
        F.coalesce("v.id", F.lit("")).alias("advisory"),
        F.coalesce("v.summary", F.lit("")).alias("summary"),
        F.when(F.coalesce(F.size("v.severity"), F.lit(0)) < 1, "unknown").otherwise(cvss_severity(F.coalesce(score["score"], F.lit("0")))).alias("severity"),
        F.coalesce(fixed, F.lit("")).alias("fixed_in"),
        F.coalesce(url, F.lit("")).alias("url"),
        F.coalesce("v.aliases", F.array().cast("array<string>")).alias("aliases"),
        F.explode_outer(F.transform(F.col("v.affected"), lambda a: a["package"])).alias("package"),
    ).select("*", "package.name", "package.ecosystem").drop("package")


def _version(text: Column) -> Column:
    """Dotted numbers up to the first part that is none; compares like the numbers do."""
    parts = F.transform(F.split(F.regexp_replace(text, "^v", ""), r"\."), lambda x: x.try_cast("int"))
    first_bad = F.array_position(F.transform(parts, lambda x: x.isNull()), True)
    return F.when(first_bad > 0, F.slice(parts, F.lit(1), (first_bad - 1).cast("int"))).otherwise(parts)


def version_at_least(version: Column, least: Column) -> Column:
    return _version(version) >= _version(least)


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Dependencies with the advisories of their package that no fixed version below theirs answers.

    An equi-join on name and ecosystem; a version of * is always affected, as is one of an advisory without a fix."""
    joined = deps.join(advisories, ["name", "ecosystem"])
    return joined.where((F.col("version") == "*") | (F.col("fixed_in") == "") | ~version_at_least(F.col("version"), F.col("fixed_in")))


def by_severity(vulnerabilities: DataFrame) -> DataFrame:
    """Vulnerable dependencies in order of severity, unknown ones last."""
    return vulnerabilities.orderBy(severity_rank(F.col("severity")), "name", "advisory")
