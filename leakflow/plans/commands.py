"""Queries over command lines, durations and decoys made from events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakflow.functions import commands, secrets
from leakflow.plans.documents import _VOCABULARY_SQL, TOKENS_SQL, tokens
from leakflow.plans.registry import ORACLE_SQL, QUERIES, query, read


@query(
    "argv_verbs",
    """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE event_type END AS verb, CASE event_id % 5 WHEN 1 THEN 'alias.x' END AS alias,
    (CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE -1 END)::INTEGER AS verb_at FROM events""",
)
def argv_verbs(spark, sf_dir):
    kind = F.col("event_id") % 5
    word = lambda *w: F.array(*(F.col("event_type") if x is None else F.lit(x) for x in w))
    argv = F.when(kind == 0, word(None, "-x", "y")).when(kind == 1, word("-c", "Alias.x=!sh", None)).when(kind == 2, word("-C", "dir", "--bare", None)).when(kind == 3, word("--bare", "--", None)).otherwise(word("--version"))
    rows = read(spark, sf_dir, "events").select("event_id", argv.alias("argv"))
    return rows.select("event_id", commands.verb(F.col("argv")).alias("verb"), commands.alias_injection(F.col("argv")).alias("alias"), commands.verb_index(F.col("argv")).alias("verb_at"))


def _durations(events):
    u, kind = F.col("user_id"), F.col("event_id") % 4
    second = 1_000_000_000
    nanos = F.when(kind == 0, u).when(kind == 1, (u + 1) * 60 * second).when(kind == 2, (u + 1) * second + second // 2).otherwise(u % 60 * 60 * second + 3600 * second + second // 4)
    shown = commands.duration_text(nanos)
    return events.select("event_id", shown.alias("shown"), commands.parse_duration(shown).alias("nanos"))


_DURATIONS_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CASE WHEN user_id = 0 THEN '0s' WHEN user_id < 1000 THEN user_id || 'ns' ELSE rtrim(rtrim(user_id // 1000 || '.' || lpad((user_id % 1000)::VARCHAR, 3, '0'), '0'), '.') || 'µs' END
      WHEN 1 THEN CASE WHEN user_id + 1 >= 60 THEN (user_id + 1) // 60 || 'h' ELSE '' END || (user_id + 1) % 60 || 'm0s'
      WHEN 2 THEN CASE WHEN user_id + 1 >= 3600 THEN (user_id + 1) // 3600 || 'h' ELSE '' END || CASE WHEN user_id + 1 >= 60 THEN (user_id + 1) // 60 % 60 || 'm' ELSE '' END || (user_id + 1) % 60 || '.5s' ELSE '1h' || user_id % 60 || 'm0.25s' END AS shown,
    CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN (user_id + 1) * 60000000000 WHEN 2 THEN (user_id + 1) * 1000000000 + 500000000 ELSE 3600250000000 + user_id % 60 * 60000000000 END::BIGINT AS nanos
    FROM events"""


@query("durations", _DURATIONS_SQL)
def durations(spark, sf_dir):
    """Durations of all events, also those of many hours."""
    return _durations(read(spark, sf_dir, "events"))


QUERIES["durations_all"], ORACLE_SQL["durations_all"] = durations, _DURATIONS_SQL


@query(
    "status_output",
    "SELECT event_id, event_type AS branch, user_id AS ahead, user_id + 1 AS behind, 1::BIGINT AS staged, 2::BIGINT AS unstaged, 1::BIGINT AS conflicts, (user_id % 3)::BIGINT AS untracked FROM events",
)
def status_output(spark, sf_dir):
    u = F.col("user_id").cast("string")
    text = F.concat(
        F.lit("# branch.head "), F.col("event_type"), F.lit("\n# branch.oid abc\n# branch.ab +"), u, F.lit(" -"), (F.col("user_id") + 1).cast("string"),
        F.lit("\n1 M. N... x\n1 .M N... y\n2 .R N... z\nu UU N... w\n"), F.repeat(F.lit("? new\n"), (F.col("user_id") % 3).cast("int")),
    )
    s = read(spark, sf_dir, "events").select("event_id", commands.status_counts(text).alias("s"))
    return s.select("event_id", "s.branch", "s.ahead", "s.behind", "s.staged", "s.unstaged", "s.conflicts", "s.untracked")


@query("clean_paths", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'a/c' WHEN 1 THEN '/b' ELSE '../x' END AS clean FROM pages")
def clean_paths(spark, sf_dir):
    raw = F.when(F.col("page_id") % 3 == 0, "./a//b/../c/").when(F.col("page_id") % 3 == 1, "/../a/../b/.").otherwise("a/../../x")
    return read(spark, sf_dir, "pages").select("page_id", commands.clean_path(raw).alias("clean"))


@query("decoys")
def decoys(spark, sf_dir):
    """Decoys keep a token's length and character classes."""
    return tokens(spark, sf_dir).select("doc_id", "token", secrets.obfuscate(F.col("token")).alias("decoy"))


@query("decoy_shapes", f"SELECT doc_id, token, length(token)::INTEGER AS n, regexp_replace(regexp_replace(token, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g') AS shape FROM ({TOKENS_SQL})")
def decoy_shapes(spark, sf_dir):
    """Lengths and character classes of decoys, which are those of the tokens."""
    made = secrets.obfuscate(F.col("token"))
    return tokens(spark, sf_dir).select("doc_id", "token", F.length(made).alias("n"), F.regexp_replace(F.regexp_replace(made, "[0-9]", "9"), "[a-z]", "a").alias("shape"))


def _quarters(texts: list[str]) -> list[int]:
    """A tokenizer of four characters a token."""
    return [len(t) // 4 + 1 for t in texts]


@query("token_ratios", f"SELECT doc_id, token, strlen(token)::DOUBLE / (length(token) // 4 + 1) AS ratio, strlen(token)::DOUBLE / (length(token) // 4 + 1) >= 2.5 AS fails FROM ({TOKENS_SQL})")
def token_ratios(spark, sf_dir):
    """Bytes for each token, and which tokens read like words by it, with a tokenizer of the caller."""
    rows = tokens(spark, sf_dir).withColumn("ratio", secrets.token_ratio(F.col("token"), _quarters).cast("double"))
    return rows.select("doc_id", "token", "ratio", secrets.fails_efficiency(F.col("token"), F.col("ratio"), F.lit(False), F.lit(False)).alias("fails"))


@query("vocabulary_ratios")
def vocabulary_ratios(spark, sf_dir):
    """Bytes for each token of a public vocabulary, of all distinct words of all texts, and which of them read like words by it."""
    import public_tokenizers

    words = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\t\n\r ]+"), F.lit(0))).alias("token")).distinct()
    counted = words.withColumn("ratio", secrets.token_ratio(F.col("token"), secrets.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json"))))
    return counted.select("token", "ratio", secrets.fails_efficiency(F.col("token"), F.col("ratio"), F.lit(False), F.lit(False)).alias("fails"))


@query("object_counts", "SELECT event_id, user_id AS loose, user_id + 2 AS packed, event_id % 5 AS packs, event_id % 4 AS unreachable FROM events")
def object_counts(spark, sf_dir):
    """Numbers of loose and packed objects, and of unreachable ones, from the texts that tell them."""
    number = lambda c: F.expr(c).cast("string")
    counted = F.concat(F.lit("count: "), number("user_id"), F.lit("\nsize: 7\nin-pack: "), number("user_id + 2"), F.lit("\npacks: "), number("event_id % 5"), F.lit("\nsize-pack: 3\ngarbage: 0\n"))
    checked = F.concat(F.lit("dangling commit ab\n"), F.repeat(F.lit("unreachable blob cd\n"), F.expr("cast(event_id % 4 as int)")))
    rows = read(spark, sf_dir, "events").select("event_id", commands.object_counts(counted).alias("c"), commands.unreachable_count(checked).alias("unreachable"))
    return rows.select("event_id", "c.loose", "c.packed", "c.packs", "unreachable")


@query("shortened_argv", "SELECT event_id, CASE WHEN length(c) > 14 THEN left(c, 13) || '…' ELSE c END AS short FROM (SELECT event_id, 'git ' || event_type || ' ' || user_id AS c FROM events)")
def shortened_argv(spark, sf_dir):
    argv = F.to_json(F.array(F.lit("git"), F.col("event_type"), F.col("user_id").cast("string")))
    return read(spark, sf_dir, "events").select("event_id", commands.short_argv(argv, 14).alias("short"))


@query(
    "dictionary_parts",
    f"""WITH {_VOCABULARY_SQL.format(n=4)}, t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\t\\n\\r ]+')) AS token FROM documents),
    s AS (SELECT token, unnest(range(0, length(token) - 3)) AS i FROM t), c AS (SELECT token, i, unnest(range(4, least(length(token) - i, (SELECT max(length(w)) FROM words)) + 1)) AS n FROM s)
    SELECT token, i::INTEGER AS start, lower(substr(token, i + 1, n)) AS word FROM c WHERE lower(substr(token, i + 1, n)) IN (SELECT w FROM words)""",
)
def dictionary_parts(spark, sf_dir):
    """All tokens of all texts against the benchmark's vocabulary: every word in them, of any length, overlapping ones too."""
    docs = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\t\n\r ]+"), F.lit(0))).alias("token"))
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return secrets.dictionary_parts(words, docs, 4)


@query(
    "diff_hunks",
    """SELECT lower(lpad(to_hex(doc_id), 40, '0')) AS commit, 'A B' AS author_name, 'a@b' AS author_email, 'docs/' || doc_id || '.txt' AS new_path, doc_id % 2 = 0 AS is_new, 1::BIGINT AS new_start, len(string_split(text, chr(10)))::BIGINT AS new_lines, text || chr(10) AS added
    FROM documents""",
)
def diff_hunks(spark, sf_dir):
    """Documents as added files of commits, written as diff text and parsed again; a carriage return is part of its line."""
    from leakflow.sources import files

    docs = read(spark, sf_dir, "documents")
    path, lines = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.split("text", "\n", -1)
    text = F.concat(
        F.lit("commit "), F.lower(F.lpad(F.hex("doc_id"), 40, "0")), F.lit("\nAuthor: A B <a@b>\nDate:   Mon Jan 2 15:04:05 2006 -0700\n\n    a change\n\ndiff --git a/"), path, F.lit(" b/"), path,
        F.when(F.col("doc_id") % 2 == 0, F.lit("\nnew file mode 100644")).otherwise(F.lit("")), F.lit("\n--- /dev/null\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"), F.size(lines).cast("string"), F.lit(" @@\n"),
        F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"), F.lit("\n"),
    )
    hunks = files.diff_hunks(docs.select(text.alias("text")))
    return hunks.select("commit", "author_name", "author_email", "new_path", "is_new", "new_start", "new_lines", "added")


@query("file_chunks", "SELECT doc_id::VARCHAR AS path, sum(strlen(text))::BIGINT AS n_bytes, min(1)::BIGINT AS first_line, text FROM documents WHERE text <> '' GROUP BY doc_id, text")
def file_chunks(spark, sf_dir):
    """Documents cut into chunks of 4,000 bytes and put together again."""
    from leakflow.sources import files

    # a row is a file of its own, also where ids repeat
    path = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.monotonically_increasing_id().cast("string"))
    docs = read(spark, sf_dir, "documents").filter("text <> ''").select(path.alias("path"), F.encode("text", "utf-8").alias("content"))
    chunks = files.file_fragments(docs, 4_000, numbered=True)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "raw"))), lambda c: c["raw"]), "")
    whole = chunks.groupBy("path").agg(F.sum(F.octet_length("raw").cast("long")).alias("n_bytes"), F.min("start_line").alias("first_line"), joined.alias("text"))
    texts = whole.select(F.nullif(F.substring_index("path", "/", 1), F.lit("")).alias("path"), "n_bytes", "first_line", "text")
    return texts.groupBy("path", "text").agg(F.sum("n_bytes").alias("n_bytes"), F.min("first_line").alias("first_line")).select("path", "n_bytes", "first_line", "text")
