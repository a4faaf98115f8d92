"""Queries over graphs made from orders, parts and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leakflow.functions import masking, places
from leakflow.operators import detect, graph, rewrite, scrub
from leakflow.plans.registry import query, read
from leakflow.session import shuffled, staged
from leakflow.sources import fastexport

#: A graph with merges: node k has the parents k/2 and k/3.
_EDGES_SQL = "edges AS (SELECT DISTINCT oid, parent FROM (SELECT p_partkey AS oid, p_partkey // 2 AS parent FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE parent > 0)"


def edges(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid"))
    both = part.select("oid", F.expr("oid div 2").alias("parent")).unionByName(part.select("oid", F.expr("oid div 3").alias("parent")))
    return both.filter("parent > 0").distinct()


def _tips(spark, sf_dir, which: str):
    """Nodes of the table that references point at."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid")).filter(which)


_LEFT, _RIGHT, _LEAVES = "oid % 100 = 99", "oid % 100 = 50", "oid NOT IN (SELECT parent FROM edges)"


def _reach_sql(name: str, which: str) -> str:
    return f"{name} AS (SELECT oid FROM (SELECT p_partkey AS oid FROM part) WHERE {which} UNION SELECT e.parent FROM edges e JOIN {name} r ON e.oid = r.oid)"


@query("graph_reach", f"WITH RECURSIVE {_EDGES_SQL}, {_reach_sql('r', _LEAVES)} SELECT oid FROM r")
def graph_reach(spark, sf_dir):
    """What all nodes without a child reach."""
    graph_edges = edges(spark, sf_dir)
    tips = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("oid")).join(graph_edges.select(F.col("parent").alias("oid")).distinct(), "oid", "left_anti")
    return graph.reachable(graph_edges, tips)


@query("graph_range_diff", f"WITH RECURSIVE {_EDGES_SQL}, {_reach_sql('a', _LEFT)}, {_reach_sql('b', _RIGHT)} SELECT oid FROM a EXCEPT SELECT oid FROM b")
def graph_range_diff(spark, sf_dir):
    """References at one node of each hundred, against those at another."""
    return graph.range_difference(edges(spark, sf_dir), _tips(spark, sf_dir, _LEFT), _tips(spark, sf_dir, _RIGHT))


@query("graph_merged_range", f"WITH RECURSIVE {_EDGES_SQL}, {_reach_sql('a', f'{_LEFT} OR {_RIGHT}')} SELECT oid FROM a")
def graph_merged_range(spark, sf_dir):
    return graph.merged_range(edges(spark, sf_dir), _tips(spark, sf_dir, _LEFT), _tips(spark, sf_dir, _RIGHT))


@query(
    "residual_refs",
    f"""WITH RECURSIVE {_EDGES_SQL}, s AS (SELECT 'r' || p_partkey AS ref, p_partkey AS oid FROM part WHERE p_partkey % 100 = 99 UNION SELECT s.ref, e.parent FROM edges e JOIN s ON e.oid = s.oid)
    SELECT ref, count(*)::BIGINT AS n FROM s JOIN part ON p_partkey = oid WHERE p_size > 25 GROUP BY ref""",
)
def residual_refs(spark, sf_dir):
    """References, one for each hundred nodes, from which large parts are reached."""
    refs = _tips(spark, sf_dir, _LEFT).select(F.concat(F.lit("r"), F.col("oid").cast("string")).alias("ref"), "oid")
    holders = read(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("oid"))
    return graph.refs_that_hold(refs, edges(spark, sf_dir), holders)


@query(
    "first_introduction",
    """SELECT oid, date, commit, path FROM (SELECT l_partkey AS oid, o_orderdate AS date, o_orderkey AS commit, l_linenumber AS path,
    row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate, o_orderkey, l_linenumber) AS rn FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE rn = 1""",
)
def first_introduction(spark, sf_dir):
    commits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("date"))
    touches = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("oid"), F.col("l_linenumber").alias("path"))
    return graph.first_introductions(touches.join(commits, "commit"), more=("path",))


def _directories(spark, sf_dir):
    """(commits, tree entries, documents) of documents as files of directories by source, language and number; each is also a commit of one of its directories."""
    text = lambda c: F.coalesce(c, F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text("source").alias("s"), text("lang").alias("l"), F.expr("cast(doc_id div 64 as string)").alias("b"), F.md5(text("text")).alias("blob"))
    source, lang, bucket = F.concat(F.lit("s:"), "s"), F.concat_ws(":", F.lit("l"), "s", "l"), F.concat_ws(":", F.lit("b"), "s", "l", "b")
    own = F.when(F.col("doc_id") % 3 == 0, source).when(F.col("doc_id") % 3 == 1, lang).otherwise(bucket)
    commits = docs.select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("oid"), own.alias("tree"), (F.col("doc_id") * 37 % 1009).alias("date"))
    entry = lambda tree, name, oid, kind: docs.select(tree.alias("tree_oid"), name.alias("name"), oid.alias("oid"), F.lit(kind).alias("kind"))
    trees = entry(source, F.col("l"), lang, "tree").unionByName(entry(lang, F.col("b"), bucket, "tree")).distinct()
    blobs = entry(bucket, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("blob"), "blob")
    return commits, trees.unionByName(blobs), docs


_DIRS_SQL = "d AS (SELECT doc_id, coalesce(source, '') AS s, coalesce(lang, '') AS l, (doc_id // 64)::VARCHAR AS b, md5(coalesce(text, '')) AS blob, (doc_id * 37) % 1009 AS date, 'c' || doc_id AS commit FROM documents)"


@query(
    "tree_introductions",
    f"""WITH {_DIRS_SQL}, roots AS (SELECT 's:' || s AS tree, date, commit FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT 'l:' || s || ':' || l, date, commit FROM d WHERE doc_id % 3 = 1 UNION ALL SELECT 'b:' || s || ':' || l || ':' || b, date, commit FROM d WHERE doc_id % 3 = 2),
    first AS (SELECT tree, date, commit FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY date, commit) AS rn FROM roots) WHERE rn = 1),
    held AS (SELECT blob, 's:' || s AS tree, l || '/' || b || '/' || doc_id || '.txt' AS path FROM d UNION ALL SELECT blob, 'l:' || s || ':' || l, b || '/' || doc_id || '.txt' FROM d UNION ALL SELECT blob, 'b:' || s || ':' || l || ':' || b, doc_id || '.txt' FROM d)
    SELECT blob AS oid, path, commit, date FROM (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY date, commit, path) AS rn FROM held JOIN first USING (tree)) WHERE rn = 1""",
)
def tree_introductions(spark, sf_dir):
    """Documents as files of directories by source, language and number; each is also a commit of one of its directories."""
    commits, entries, _ = _directories(spark, sf_dir)
    return graph.tree_introductions(commits, entries)


@query(
    "blobs_at_commits",
    f"""WITH {_DIRS_SQL}, w AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN l || '/' || b || '/' WHEN 1 THEN b || '/' ELSE '' END AS folder FROM d)
    SELECT commit, folder || doc_id || '.txt' AS path, blob AS oid FROM w UNION ALL SELECT commit, folder || doc_id, NULL FROM w WHERE doc_id % 7 = 0
    UNION ALL SELECT commit, left(folder, length(folder) - 1), NULL FROM w WHERE doc_id % 3 < 2 UNION ALL SELECT commit || 'x', folder || doc_id || '.txt', NULL FROM w WHERE doc_id % 11 = 0""",
)
def blobs_at_commits(spark, sf_dir):
    """Each document's file at its own commit; also names that aren't there, folders, and commits that aren't known."""
    commits, entries, docs = _directories(spark, sf_dir)
    k = F.col("doc_id")
    name, folder = k.cast("string"), F.when(k % 3 == 0, F.concat("l", F.lit("/"), "b", F.lit("/"))).when(k % 3 == 1, F.concat("b", F.lit("/"))).otherwise(F.lit(""))
    commit, file = F.concat(F.lit("c"), name), F.concat(folder, name, F.lit(".txt"))
    ask = lambda when, c, path: docs.filter(when).select(c.alias("commit"), path.alias("path"))
    wanted = ask(F.lit(True), commit, file).unionByName(ask(k % 7 == 0, commit, F.concat(folder, name)))
    wanted = wanted.unionByName(ask(k % 3 < 2, commit, F.regexp_replace(folder, "/$", ""))).unionByName(ask(k % 11 == 0, F.concat(commit, F.lit("x")), file))
    return graph.blobs_at(wanted, commits.select("oid", "tree"), entries)


@query(
    "tree_expand",
    """SELECT 'root' AS root, r_name || '/' || n_name || '/' || c_name AS path, 'c' || c_custkey AS oid
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""",
)
def tree_expand(spark, sf_dir):
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    oid = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    entries = (
        region.select(F.lit("root").alias("tree_oid"), F.col("r_name").alias("name"), oid("r", "r_regionkey").alias("oid"), F.lit("tree").alias("kind"))
        .unionByName(nation.select(oid("r", "n_regionkey").alias("tree_oid"), F.col("n_name").alias("name"), oid("n", "n_nationkey").alias("oid"), F.lit("tree").alias("kind")))
        .unionByName(customer.select(oid("n", "c_nationkey").alias("tree_oid"), F.col("c_name").alias("name"), oid("c", "c_custkey").alias("oid"), F.lit("blob").alias("kind")))
    )
    return graph.expand_tree(entries, spark.createDataFrame([("root",)], "root string"))


@query("file_change_collisions", "SELECT l_orderkey AS commit, l_suppkey % 7 AS path, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def file_change_collisions(spark, sf_dir):
    return rewrite.collisions(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), (F.col("l_suppkey") % 7).alias("path")))


@query(
    "identity_rewrite",
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_name = 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') THEN 'hidden' ELSE c_name END AS name, CASE WHEN c_mktsegment = 'BUILDING' AND c_name = 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') THEN 'hidden@x' ELSE c_mktsegment END AS email FROM customer",
)
def identity_rewrite(spark, sf_dir):
    customers = read(spark, sf_dir, "customer")
    own = F.when(F.col("c_name") == F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), "same").otherwise(F.col("c_name"))
    name, email = rewrite.rewrite_identity(own, F.col("c_mktsegment"), "same", "BUILDING", "hidden", "hidden@x")
    return customers.select("c_custkey", F.when(name == "same", F.col("c_name")).otherwise(name).alias("name"), email.alias("email"))


@query(
    "prune_commits",
    """SELECT o.o_orderkey AS oid FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) FILTER (l_quantity > 45) AS left_, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
    WHERE coalesce(left_, 0) = 0 AND o_custkey % 3 < 2 AND coalesce(n, 0) > 0""",
)
def prune_commits(spark, sf_dir):
    left = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("oid")).agg(F.count_if(F.col("l_quantity") > 45).alias("n_changes"), F.count("*").alias("n"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), (F.col("o_custkey") % 3).alias("n_parents"))
    commits = orders.join(left, "oid", "left").select("oid", "n_parents", (F.coalesce("n", F.lit(0)) > 0).alias("had_changes"), F.coalesce("n_changes", F.lit(0)).alias("n_changes"))
    return rewrite.prunable(commits).select("oid")


@query(
    "prune_survivors",
    """WITH RECURSIVE p AS (SELECT p_partkey AS oid, CASE WHEN p_partkey // 2 > 0 THEN p_partkey // 2 END AS parent FROM part),
    w AS (SELECT oid, parent FROM p WHERE oid % 3 <> 1 UNION ALL SELECT w.oid, p.parent FROM w JOIN p ON w.parent = p.oid WHERE p.oid % 3 <> 1)
    SELECT oid::VARCHAR AS oid, parent::VARCHAR AS parent FROM w WHERE parent IS NULL OR parent % 3 = 1""",
)
def prune_survivors(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    parents = part.select(F.col("k").cast("string").alias("oid"), F.expr("cast(nullif(k div 2, 0) as string)").alias("parent")).filter("parent is not null")
    return graph.survivors(parents, part.filter("k % 3 <> 1").select(F.col("k").cast("string").alias("oid")))


@query(
    "scrub_plan",
    """WITH d AS (SELECT 's' || coalesce(source, '') AS stream, doc_id, coalesce(lang, 'xx') AS lang, coalesce(text, '') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    f AS (SELECT *, doc_id % 5 <> 0 AS had, doc_id % 5 <> 0 AND lang = 'fr' AS emptied, doc_id % 5 = 0 AND n > 1 AS follows FROM d),
    g AS (SELECT *, CASE WHEN follows THEN last_value(CASE WHEN NOT follows THEN emptied END IGNORE NULLS) OVER w ELSE emptied END AS pruned FROM f WINDOW w AS (PARTITION BY stream ORDER BY n)),
    h AS (SELECT *, sum(CASE WHEN pruned THEN 0 WHEN had THEN 2 ELSE 1 END) OVER (PARTITION BY stream ORDER BY n)::BIGINT AS mark FROM g),
    p AS (SELECT *, last_value(CASE WHEN NOT pruned THEN mark END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM h)
    SELECT stream, 2 * n AS seq, CASE WHEN pruned THEN 'reset' ELSE 'commit' END AS kind, CASE WHEN NOT pruned THEN mark END AS mark, ':' || parent AS parent, CASE WHEN had AND NOT pruned THEN CASE lang WHEN 'en' THEN 'english' ELSE lang END || '/' || doc_id || '.txt' END AS path, NULL::VARCHAR AS digest FROM p WHERE NOT pruned OR parent IS NOT NULL
    UNION ALL SELECT stream, 2 * n - 1, 'blob', mark - 1, NULL, NULL, md5(CASE WHEN contains(t, chr(0)) THEN t ELSE replace(t, ' the ', ' *** ') END) FROM p WHERE had AND NOT pruned""",
)
def scrub_plan(spark, sf_dir):
    """Documents as the history of each source: a blob and a commit each, some of them empty; one language goes, one directory is renamed, a word is replaced."""
    text = lambda c, x: F.coalesce(c, F.lit(x))
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("s"), text("source", "")).alias("stream"), "doc_id", text("lang", "xx").alias("lang"), F.encode(text("text", ""), "utf-8").alias("data"))
    k, whole = F.col("doc_id"), lambda x: x.cast("string")
    # numbers and parents are found without the texts, which stay where they are read
    numbers = staged(scrub.dense_numbers(docs.select("stream", "doc_id"), "stream", "doc_id", "n").select("stream", "doc_id", "n"), "numbers")
    before = numbers.select("stream", (F.col("n") + 1).alias("n"), F.col("doc_id").alias("before"))
    known = docs.drop("data").join(shuffled(numbers.join(shuffled(before), ["stream", "n"], "left").select("doc_id", "before")), "doc_id")
    change = F.struct(F.lit("M").alias("kind"), F.lit("100644").alias("mode"), F.concat(F.lit(":"), whole(2 * k + 1)).alias("ref"), F.concat("lang", F.lit("/"), whole(k), F.lit(".txt")).alias("path"), F.lit(None).cast("string").alias("new_path"))
    changes = F.when(k % 5 != 0, F.array(change)).otherwise(F.array().cast(fastexport.CHANGES))
    given = {"stream": F.col("stream")}
    blob = given | {"seq": 2 * k, "kind": F.lit("blob"), "mark": 2 * k + 1, "data": F.col("data")}
    commit = given | {"seq": 2 * k + 1, "kind": F.lit("commit"), "mark": 2 * k + 2, "name": F.lit("refs/heads/main"), "committer": F.lit("A <a@b> 1 +0000"), "parent": F.concat(F.lit(":"), whole(2 * F.col("before") + 2)), "changes": changes}
    row = lambda rows, values: rows.select(*(values.get(c.split(" ")[0], F.lit(None)).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in fastexport.RECORDS.split(", ")))
    rules = rewrite.parse_path_rules(["en/==>english/"])
    path_of = lambda p: F.when(~p.startswith("fr/"), rewrite.new_path(p, rules))
    made = scrub.scrub(row(docs, blob).unionByName(row(known, commit)), lambda t: masking.replace_text(t, [(" the ", " *** ")]), path_of)
    told = made.select("stream", F.expr("seq div 2").alias("doc_id"), (F.col("seq") % 2).alias("odd"), "kind", "mark", "parent", F.get("changes", F.lit(0))["path"].alias("path"), F.md5("data").alias("digest"))
    return told.join(shuffled(numbers), ["stream", "doc_id"]).select("stream", (2 * F.col("n") - 1 + F.col("odd")).alias("seq"), "kind", "mark", "parent", "path", "digest")


@query("plan_stats", "SELECT count(DISTINCT l_partkey)::BIGINT AS n_blobs, count(DISTINCT l_orderkey)::BIGINT AS n_commits FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def plan_stats(spark, sf_dir):
    blobs = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("oid"), F.col("l_orderkey").alias("commit"), F.array("l_suppkey").alias("secrets"))
    return rewrite.plan_stats(blobs, read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("secret")))


@query("commit_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') AS rfc1123, strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS parsed FROM orders")
def commit_dates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    raw = F.concat(F.date_format("t", "EEE MMM d HH:mm:ss yyyy"), F.lit(" +0200"))
    seconds = F.unix_seconds("t")
    return orders.select("o_orderkey", places.rfc3339(seconds).alias("rfc3339"), places.rfc1123(seconds).alias("rfc1123"), places.parse_commit_date(raw).alias("parsed"))


@query(
    "trace_findings",
    """SELECT o_orderkey, f AS fingerprint FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'v1:' ELSE '' END || 'src/' || o_custkey || ':rule:' || o_orderkey AS f FROM orders)
    WHERE f = 'src/12' OR f[:7] = 'src/12' OR f[:6] = 'src/12' OR (f[:3] = 'v1:' AND f[4:9] = 'src/12')""",
)
def trace_findings(spark, sf_dir):
    """Orders as findings, some with an acknowledgement's prefix, looked up by the beginning of a fingerprint."""
    head = F.when(F.col("o_orderkey") % 2 == 0, "v1:").otherwise("")
    text = F.concat(head, F.lit("src/"), F.col("o_custkey").cast("string"), F.lit(":rule:"), F.col("o_orderkey").cast("string"))
    return detect.traced(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("fingerprint")), " src/12 ")


@query(
    "blob_paths",
    """SELECT DISTINCT id, path FROM (SELECT DISTINCT left(md5(s_suppkey::VARCHAR), 4 + s_suppkey % 3) AS id FROM supplier)
    JOIN (SELECT md5(p_partkey::VARCHAR) AS oid, p_partkey AS k FROM part) ON starts_with(oid, id)
    JOIN (SELECT l_partkey, l_orderkey || '/' || l_linenumber AS path FROM lineitem) ON l_partkey = k""",
)
def blob_paths(spark, sf_dir):
    """Paths of parts in all line items, of objects named by four to six characters."""
    md5 = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    ids = read(spark, sf_dir, "supplier").select(F.substr(md5("s_suppkey"), F.lit(1), (F.lit(4) + F.col("s_suppkey") % 3).cast("int")).alias("id"))
    return graph.paths_of(read(spark, sf_dir, "lineitem").select(md5("l_partkey").alias("oid"), path.alias("path")), ids)
