"""Queries of the llm operators and, where it can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.contamination import leaked_items
from lintlake.llm.handwritten import fit, not_handwritten
from lintlake.llm.packing import pack_documents
from lintlake.llm.quality import text_quality
from lintlake.llm.secrets import redacted, secrets_in
from lintlake.llm.splitting import split_oversized
from lintlake.sources.tables import first_sent, table

# ---------------------------------------------------------------- repository files


def _project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repo_snapshot").select("snapshot_id", "root", "structure", F.explode("file_contents").alias("file", "content")).where("content is not null")


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, class and evidence of every file."""
    files = _project_files(spark, sf_dir)
    return not_handwritten(files, fit(files, table(spark, sf_dir, "repo_snapshot")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_files(spark, sf_dir).where("score > 0").select("snapshot_id", "file").distinct()


def p3_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifiers do on the labels of held-out repositories."""
    report = fit(_project_files(spark, sf_dir), table(spark, sf_dir, "repo_snapshot")).report
    return spark.createDataFrame([tuple(r) for r in report], "class string, train_files int, train_positive int, held_files int, held_positive int, precision double, recall double")


def _with_limits(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """Files with the limit and overlap of their row's config; no or an unknown config means the one named default.
    once: without the rows that are sent again."""
    config = table(spark, sf_dir, "ai_review_config").select("config_id", "name", "max_file_size", "context_lines")
    snapshots = table(spark, sf_dir, "repo_snapshot").select("snapshot_id", "config_id", "file_contents", "received_at")
    snapshots = first_sent(snapshots, "snapshot_id", "received_at") if once else snapshots
    # the configurations are a fixed table, which Spark broadcasts by its own size check; the default's
    # two numbers are scalar subqueries
    return spark.sql(
        """
        SELECT snapshot_id, most, lines, file, content FROM (
          SELECT s.snapshot_id, s.file_contents,
            CASE WHEN c.known THEN c.max_file_size ELSE (SELECT min_by(max_file_size, config_id) FROM {config} WHERE name = 'default') END AS most,
            CASE WHEN c.known THEN c.context_lines ELSE (SELECT min_by(context_lines, config_id) FROM {config} WHERE name = 'default') END AS lines
          FROM {snapshots} s LEFT JOIN (SELECT *, true AS known FROM {config}) c ON s.config_id = c.config_id)
        LATERAL VIEW explode(file_contents) AS file, content""",
        config=config,
        snapshots=snapshots,
    )


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized files; a re-sent snapshot counts once."""
    return split_oversized(_with_limits(spark, sf_dir, once=True), "content", F.col("most"), F.col("lines")).drop("most", "lines")


def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each oversized file make up again: its characters, whether every piece stays within the
    limit and holds what stands at its place, and whether no place is left out. Only numbers are shuffled."""
    pieces = split_oversized(_with_limits(spark, sf_dir, once=True).withColumn("whole", F.col("content")), "content", F.col("most"), F.col("lines"))
    own = F.length("piece_text") - F.col("piece_overlap")
    same = F.col("piece_text") == F.substring("whole", F.col("piece_start") - F.col("piece_overlap") + 1, F.length("piece_text"))
    told = pieces.select("snapshot_id", "file", "piece_no", "piece_start", own.alias("own"), (F.length("piece_text") <= F.col("most")).alias("within"), same.alias("same"))
    reach = F.sum(F.col("own").cast("long")).alias("chars")
    per = told.groupBy("snapshot_id", "file").agg(reach, F.every("within").alias("within"), F.every("same").alias("same"), (F.max(F.col("piece_start") + F.col("own")) == F.sum("own")).alias("gapless"))
    return per


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_oversized(_with_limits(spark, sf_dir), "content", F.col("most"), F.col("lines"))
    return pieces.where("piece_count > 1 and length(piece_text) > 0").select("snapshot_id", "file").distinct()


def _code_texts(spark: SparkSession, sf_dir: str, once: bool = False) -> list[DataFrame]:
    """Texts that may hold credentials, as place, row_id, file, content; once: without the rows that are sent again."""

    def rows(name: str, key: str, arrival: str, *columns: str) -> DataFrame:
        found = table(spark, sf_dir, name).select(key, arrival, *columns)
        return first_sent(found, key, arrival) if once else found

    files = rows("repo_snapshot", "snapshot_id", "received_at", "file_contents").select("snapshot_id", F.explode("file_contents").alias("file", "content")).where("content is not null")
    patches = rows("pr", "pr_id", "fetched_at", "files").select("pr_id", F.explode("files").alias("f"))
    return [
        files.select(F.lit("repo_snapshot").alias("place"), F.col("snapshot_id").alias("row_id"), "file", "content"),
        patches.select(F.lit("pr").alias("place"), F.col("pr_id").alias("row_id"), F.col("f.filename").alias("file"), F.col("f.patch").alias("content")),
        rows("finding", "finding_id", "found_at", "file", "match").select(F.lit("finding").alias("place"), F.col("finding_id").alias("row_id"), "file", F.col("match").alias("content")),
    ]


def p5_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential with its place in its text."""
    found = [secrets_in(texts, "content", ["place", "row_id", "file"]) for texts in _code_texts(spark, sf_dir)]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_credentials(spark, sf_dir).select("place", "row_id", "file", F.when(F.col("place") == "finding", F.lit(1)).otherwise(F.col("line")).alias("line")).distinct()


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that holds credentials, with these replaced; re-sent rows count once. No text is shuffled."""
    clean = [redacted(texts, "content", ["place", "row_id", "file"]) for texts in _code_texts(spark, sf_dir, once=True)]
    return clean[0].unionByName(clean[1]).unionByName(clean[2])


# ---------------------------------------------------------------- documents


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container of each kind, by tokens of a public tokenizer."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "pack_capacity"))


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are."""
    used = p6_packed(spark, sf_dir).groupBy("container_kind", "container_no").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    kinds = table(spark, sf_dir, "pack_capacity")
    return used.join(kinds, "container_kind").groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count(F.lit(1)) * F.first("capacity_tokens"))).alias("used_share"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind: documents placed, whether none is split without need or in part, and whether no container holds too much."""
    packed = p6_packed(spark, sf_dir).join(F.broadcast(table(spark, sf_dir, "pack_capacity")), "container_kind")  # a fixed table
    held = packed.groupBy("container_kind", "container_no").agg((F.sum("tokens") <= F.first("capacity_tokens")).alias("fits")).groupBy("container_kind").agg(F.every("fits").alias("fits"))
    whole = packed.groupBy("container_kind", "doc_id").agg(
        (F.max("piece_no") + 1 == F.count(F.lit(1))).alias("all"), (F.max(F.col("token_start") + F.col("tokens")) == F.sum("tokens")).alias("gapless"), ((F.count(F.lit(1)) == 1) | (F.sum("tokens") > F.first("capacity_tokens"))).alias("needed")
    )
    documents = whole.groupBy("container_kind").agg(F.count(F.lit(1)).alias("documents"), F.every(F.col("all") & F.col("gapless")).alias("whole"), F.every("needed").alias("needed"))
    return documents.join(held, "container_kind")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that carries at least half of a test item, with the share carried."""
    return leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, failed rules and verdict of every document."""
    return text_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "common_word"))


def p8_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can measure too, to six decimals."""
    stats = p8_stats(spark, sf_dir).where("words is not null")
    return stats.select("doc_id", "chars", "words", "lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "digit_ratio", "special_chars", "line_ends_per_word", "words_per_line", "short_lines")])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("not natural_prose").select("doc_id").distinct()


QUERIES = {
    "p3_found": p3_found,
    "p3_files": p3_files,
    "p3_validation": p3_validation,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_rejoined": p4_rejoined,
    "p5_found": p5_found,
    "p5_credentials": p5_credentials,
    "p5_redacted": p5_redacted,
    "p6_packed": p6_packed,
    "p6_use": p6_use,
    "p6_checked": p6_checked,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_stats": p8_stats,
    "p8_measures": p8_measures,
}

SQL = {
    "p4_found": """
        WITH c AS (SELECT config_id, max_file_size FROM ai_review_config),
        d AS (SELECT max_file_size AS usual FROM ai_review_config WHERE name = 'default'),
        f AS (SELECT snapshot_id, config_id, unnest(map_entries(file_contents)) AS e FROM repo_snapshot)
        SELECT DISTINCT snapshot_id, e.key AS file
        FROM f LEFT JOIN c USING (config_id) CROSS JOIN d WHERE length(e.value) > coalesce(c.max_file_size, usual)""",
    "p4_rejoined": """
        WITH c AS (SELECT config_id, max_file_size FROM ai_review_config),
        d AS (SELECT max_file_size AS usual FROM ai_review_config WHERE name = 'default'),
        f AS (SELECT snapshot_id, config_id, unnest(map_entries(file_contents)) AS e FROM (SELECT DISTINCT ON (snapshot_id) * FROM repo_snapshot))
        SELECT snapshot_id, e.key AS file, length(e.value) AS chars, true AS within, true AS same, true AS gapless
        FROM f LEFT JOIN c USING (config_id) CROSS JOIN d WHERE length(e.value) > coalesce(c.max_file_size, usual)""",
    "p6_checked": """
        SELECT container_kind, count(DISTINCT doc_id) AS documents, true AS whole, true AS needed, true AS fits
        FROM documents, pack_capacity WHERE text IS NOT NULL AND text != '' GROUP BY container_kind""",
    "p8_measures": r"""
        WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS w, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), lambda x: x != '') AS l FROM documents WHERE text IS NOT NULL),
        n AS (SELECT *, CASE WHEN regexp_matches(text, '[\pL\pN_]') THEN len(w) ELSE 0 END AS words, greatest(len(w), 1) AS parts, greatest(len(l), 1) AS inked FROM d)
        SELECT doc_id, length(text) AS chars, words, len(l) AS lines, round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / parts, 6) AS mean_word_length,
          round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1), 6) AS digit_ratio,
          round(length(regexp_replace(text, '[^\x00-\x7F]|[A-Za-z]|[\x00-\x08\x0E-\x1F\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS special_chars,
          round((length(text) - length(replace(text, chr(10), ''))) / parts, 6) AS line_ends_per_word, round(len(w) / inked, 6) AS words_per_line,
          round(len(list_filter(l, lambda x: length(x) <= 30)) / inked, 6) AS short_lines FROM n""",
}
