"""Source trees as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.functions.globs import ignore_predicate
from lintlake.functions.rules import ignored
from lintlake.functions.text import basename, suffix
from lintlake.operators.complexity import SKIP_FOLDERS

# What a snapshot takes up, what it passes over, and its names of languages.
TEXT_SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".rb", ".php", ".cs", ".cpp", ".c", ".swift", ".kt", ".md", ".yaml", ".yml", ".toml", ".json")
TEXT_NAMES = ("Makefile", "Dockerfile")
IGNORED_FOLDERS = (".git", ".github", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt", "coverage", ".pytest_cache", ".mypy_cache", ".ruff_cache", "target", "vendor")
LANGUAGES = {".py": "Python", ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".rb": "Ruby", ".php": "PHP", ".cs": "C#", ".cpp": "C++", ".c": "C", ".swift": "Swift", ".kt": "Kotlin", ".ex": "Elixir", ".exs": "Elixir"}


def _passed_over(file: Column) -> Column:
    return F.arrays_overlap(F.split(file, "/"), F.array(*map(F.lit, IGNORED_FOLDERS)))


def language_counts(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Languages of each key by number of files, ties by name, with their place. One row a language is ranked."""
    kinds = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    named = files.where(~_passed_over(F.col("file"))).select(*keys, F.try_element_at(kinds, suffix(F.col("file"))).alias("language")).where("language is not null")
    counts = named.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("files"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("files"), "language")))


def _decoded(column: pa.Array) -> pa.Array:
    """Bytes as text; what is no UTF-8 drops out."""
    return pa.array([None if v is None else v.decode("utf-8", "ignore") for v in column.to_pylist()], pa.string())


def read_tree(spark: SparkSession, root: str, *, suffixes: Sequence[str] | None = None, max_bytes: int = 500_000, skip_folders: Iterable[str] = SKIP_FOLDERS, ignore: Sequence[str] | None = None, ignore_file: Iterable[str] | None = None) -> DataFrame:
    """file (relative to root), bytes, content of a tree or a single file.

    Two scans: the first lists paths and lengths (content is pruned), so that only the files wanted
    are read at all; larger files keep their row with a null content, for rules on names."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = base.load(root).select("path", "length")
    clean = root.rstrip("/")
    relative = F.regexp_replace("path", "^.*?" + _quoted(clean.removeprefix("file:")) + "/?", "")
    name = F.when(relative == "", F.element_at(F.split("path", "/"), -1)).otherwise(relative)
    kept = listed.select("path", "length", name.alias("file"))
    if suffixes:
        kept = kept.where(F.col("file").rlike("(?:" + "|".join(_quoted(s) for s in suffixes) + ")$"))
    skip = list(skip_folders)
    if skip:
        kept = kept.where(~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, skip))))
    if ignore is not None:
        kept = kept.where(~ignored(F.col("file"), ignore))
    if ignore_file is not None:
        kept = kept.where(~ignore_predicate(F.col("file"), ignore_file))
    content = base.load(root).where(F.col("length") <= max_bytes).select("path", "content")
    both = kept.join(content, "path", "left").select("file", F.col("length").alias("bytes"), "content")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _decoded(b.column(2))], names=["file", "bytes", "content"])

    return both.mapInArrow(run, "file string, bytes long, content string")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E" if text else ""


def tree_text(files: DataFrame, keys: Sequence[str], depth: int = 5) -> DataFrame:
    """Folders and files of each key down to a depth as a drawn tree, folders first; hidden names and the folders
    that snapshots pass over are left out."""
    parts = F.slice(F.split("file", "/"), 1, depth)
    shown = files.where(~_passed_over(F.col("file")) & ~F.col("file").rlike(r"(?:^|/)\."))
    steps = shown.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.slice(parts, 1, n).alias("at"), (n < F.size(F.split("file", "/"))).alias("folder")))).alias("s")).select(*keys, "s.at", "s.folder").distinct()
    # a path sorts by its steps, each marked as folder (0) or file (1)
    marked = F.transform("at", lambda p, i: F.concat(F.when((i < F.size("at") - 1) | F.col("folder"), "0").otherwise("1"), p))
    above = F.array_join(F.slice("at", F.lit(1), F.size("at") - 1), "\u0001")
    placed = steps.select(*keys, "at", marked.alias("key"), above.alias("above"))
    last = placed.withColumn("last", F.col("key") == F.max("key").over(Window.partitionBy(*keys, "above")))
    # whether each of the folders above is the last of its own folder
    told = last.select(*keys, F.struct("key", F.col("at"), "last").alias("r")).groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    ends = F.map_from_entries(F.transform("rows", lambda r: F.struct(F.array_join(r["at"], "\u0001"), r["last"])))
    held = told.withColumn("ends", ends)
    prefix = lambda r: F.array_join(F.transform(F.when(F.size(r["at"]) > 1, F.sequence(F.lit(1), F.size(r["at"]) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.when(F.try_element_at("ends", F.array_join(F.slice(r["at"], F.lit(1), n), "\u0001")), "    ").otherwise("│   ")), "")
    line = lambda r: F.concat(prefix(r), F.when(r["last"], "└── ").otherwise("├── "), F.element_at(r["at"], -1))
    return held.select(*keys, F.array_join(F.transform("rows", line), "\n").alias("tree"))


def snapshot_sources(files: DataFrame, keys: Sequence[str], most_files: int = 20, most_chars: int = 3_000) -> DataFrame:
    """The shallowest text files of each key, cut to a size before they are shuffled."""
    from lintlake.operators.topn import top_n_per_group

    kind, name = suffix(F.col("file")), basename(F.col("file"))
    text = files.where((kind.isin(*TEXT_SUFFIXES) | name.isin(*TEXT_NAMES)) & ~_passed_over(F.col("file"))).withColumn("content", F.left("content", F.lit(most_chars)))
    best = top_n_per_group(text, F.to_json(F.struct(*keys)), -F.size(F.split("file", "/")), [F.col("file")], F.col("file"), most_files)
    return best.select(*keys, "file", "content", "rank")
