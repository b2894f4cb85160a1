"""Every operator over the driver's tables: a change is a pair of documents, an analysis a user's events, findings are
line items, analyses are orders. Each query has its SQL, but for the folds that SQL can't express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import matching, relational as R
from ..sources.tables import event_log, lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LINES = """l AS (SELECT CAST(doc_id - doc_id % 2 AS BIGINT) AS pid, doc_id, doc_id % 2 = 1 AS head, generate_subscripts(p, 1) AS n, unnest(p) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))"""
LOG = """log AS (SELECT user_id AS analysis_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq,
           CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'stage' WHEN 'click' THEN 'stage' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS kind, ts, event_id, value FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {LINES}, b AS (SELECT pid, line, count(*) AS k FROM l WHERE NOT head GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY pid, line ORDER BY n) AS r FROM l WHERE head) SELECT h.pid, h.n, h.line FROM h LEFT JOIN b ON h.pid = b.pid AND h.line = b.line WHERE r > coalesce(k, 0)")
def bag_diff_new_lines(spark, sf_dir):
    """Lines of head beyond those of base, in order."""
    all_lines = lines(spark, sf_dir)
    return R.new_in_head(all_lines.where("not head").select("pid", "line"), all_lines.where("head"), ["pid", "line"], ["n"]).select("pid", "n", "line")


@query(f"WITH {LINES} SELECT pid, doc_id, n, line FROM l")
def line_explode(spark, sf_dir):
    """Lines with their numbers."""
    return lines(spark, sf_dir).select("pid", "doc_id", "n", "line")


@query(f"WITH {LINES}, b AS (SELECT pid, n, line FROM l WHERE NOT head), h AS (SELECT pid, n, line FROM l WHERE head) SELECT coalesce(b.pid, h.pid) AS pid, coalesce(b.n, h.n) AS n, b.line AS base_line, h.line AS head_line FROM b FULL JOIN h ON b.pid = h.pid AND b.n = h.n WHERE b.line IS DISTINCT FROM h.line")
def line_full_outer(spark, sf_dir):
    """Both sides by line number, where they differ."""
    all_lines = lines(spark, sf_dir)
    base = all_lines.where("not head").select("pid", "n", F.col("line").alias("base_line"))
    head = all_lines.where("head").select("pid", "n", F.col("line").alias("head_line"))
    return base.join(head, ["pid", "n"], "full_outer").where("not (base_line <=> head_line)")


@query(f"WITH {LINES} SELECT pid, count(*) FILTER (head) AS added, count(*) FILTER (NOT head) AS removed FROM l GROUP BY pid")
def added_removed_counts(spark, sf_dir):
    """A1: additions and deletions of a change."""
    return lines(spark, sf_dir).groupBy("pid").agg(F.count_if("head").alias("added"), F.count_if(~F.col("head")).alias("removed"))


@query("SELECT toxic, min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n FROM (SELECT DISTINCT toxic, doc_id, doc_id - dense_rank() OVER (PARTITION BY toxic ORDER BY doc_id) AS g FROM labels) GROUP BY toxic, g")
def int_ranges(spark, sf_dir):
    """Consecutive integers as ranges."""
    return R.islands(table(spark, sf_dir, "labels"), ["toxic"], "doc_id")


@query("SELECT doc_id, 'F-' || substr(sha1('CG-DOC|' || coalesce(source, '') || '|' || coalesce(CAST(n_chars AS VARCHAR), 'None') || '|' || coalesce(lang, '')), 1, 10) AS finding_id FROM documents")
def finding_ids(spark, sf_dir):
    """Stable finding identifiers."""
    return table(spark, sf_dir, "documents").select("doc_id", X.finding_id(F.lit("CG-DOC"), F.col("source"), F.col("n_chars"), F.col("lang")).alias("finding_id"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS span_no, CAST(l_quantity AS INTEGER) AS lo, CAST(l_quantity AS INTEGER) + l_linenumber * 5 AS hi FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS pos FROM lineitem),
 j AS (SELECT p.l_orderkey, p.l_linenumber, span_no, hi - lo AS width, row_number() OVER (PARTITION BY p.l_orderkey, p.l_linenumber ORDER BY hi - lo, span_no) AS r FROM p JOIN s ON p.l_orderkey = s.l_orderkey AND p.pos BETWEEN lo AND hi)
 SELECT l_orderkey, l_linenumber, span_no, width FROM j WHERE r = 1""")
def innermost_span(spark, sf_dir):
    """The innermost span around a point."""
    items = table(spark, sf_dir, "lineitem")
    points = items.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("at"))
    spans = items.select("l_orderkey", F.col("l_linenumber").alias("span_no"), F.col("l_quantity").cast("int").alias("lo"), (F.col("l_quantity").cast("int") + F.col("l_linenumber") * 5).alias("hi"))
    return R.innermost(points, spans, ["l_orderkey"], "at", "lo", "hi", ["l_orderkey", "l_linenumber"], ["span_no"]).select("l_orderkey", "l_linenumber", "span_no", (F.col("hi") - F.col("lo")).alias("width"))


@query(f"WITH {LOG}, s AS (SELECT *, max(CASE WHEN kind = 'started' THEN seq END) OVER (PARTITION BY analysis_id ORDER BY seq) AS start_seq FROM log) SELECT analysis_id, seq, start_seq FROM s WHERE kind <> 'started' AND start_seq IS NOT NULL")
def enclosing_start(spark, sf_dir):
    """The latest start at or before each event."""
    start = F.max(F.when(F.col("kind") == "started", F.col("seq"))).over(Window.partitionBy("analysis_id").orderBy("seq"))
    return event_log(spark, sf_dir).withColumn("start_seq", start).where("kind <> 'started' and start_seq is not null").select("analysis_id", "seq", "start_seq")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_docs(spark, sf_dir):
    """Rows without a counterpart."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS w FROM documents) SELECT d.doc_id, count(*) AS n_tokens FROM d JOIN t ON d.w = t.w GROUP BY d.doc_id")
def candidate_docs(spark, sf_dir):
    """Candidates by an inverted index of identifiers."""
    words = lambda name, *c: table(spark, sf_dir, name).select(*c, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), 1))).alias("w"))
    return words("documents", "doc_id").join(words("benchmark").distinct(), "w").groupBy("doc_id").agg(F.count("*").alias("n_tokens"))


@query("SELECT a.l_orderkey, a.l_linenumber AS pred, b.l_linenumber AS label FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.l_linenumber < b.l_linenumber WHERE CAST(a.l_quantity AS INTEGER) <= CAST(b.l_quantity AS INTEGER) + 2 + 3 AND CAST(b.l_quantity AS INTEGER) - 3 <= CAST(a.l_quantity AS INTEGER) + 1")
def tolerant_overlap(spark, sf_dir):
    """Spans of one key that overlap within a tolerance."""
    items = table(spark, sf_dir, "lineitem")
    at = F.col("l_quantity").cast("int")
    a = items.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("pred"), at.alias("p_lo"), (at + 1).alias("p_hi"))
    b = items.select("l_orderkey", "l_returnflag", F.col("l_linenumber").alias("label"), at.alias("b_lo"), (at + 2).alias("b_hi"))
    return R.overlapping(a, b, ["l_orderkey", "l_returnflag"], ("p_lo", "p_hi"), ("b_lo", "b_hi"), 3).where("pred < label").select("l_orderkey", "pred", "label")


@query(f"WITH {LOG} SELECT analysis_id, seq, kind FROM log")
def event_seq(spark, sf_dir):
    """Gapless sequence numbers of a log."""
    return event_log(spark, sf_dir).select("analysis_id", "seq", "kind")


@query(f"WITH {LOG} SELECT analysis_id, seq, kind FROM log WHERE seq > 10")
def resume_after(spark, sf_dir):
    """What a reader has not seen yet."""
    return event_log(spark, sf_dir).where("seq > 10").select("analysis_id", "seq", "kind")


@query(f"WITH {LOG} SELECT analysis_id, count(*) AS n_events, arg_max(kind, seq) AS kind, arg_max(event_id, seq) AS event_id FROM log GROUP BY analysis_id")
def current_stage_state(spark, sf_dir):
    """The latest state of each log."""
    return R.last_state(event_log(spark, sf_dir), "analysis_id", "seq", ["kind", "event_id"])


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_day FROM events")
def rate_window_24h(spark, sf_dir):
    """How many of an identity's events fall in a sliding window, at whole seconds (rounded as the SQL's cast does, halves to even)."""
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("long")
    return table(spark, sf_dir, "events").withColumn("at", at).select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-86400, 0)).alias("n_day"))


@query(f"WITH {LOG}, f AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY analysis_id ORDER BY seq) THEN 1 ELSE 0 END AS c FROM log), g AS (SELECT *, sum(c) OVER (PARTITION BY analysis_id ORDER BY seq) AS run FROM f) SELECT analysis_id, CAST(run AS BIGINT) AS run, kind, min(seq) AS first_seq, count(*) AS n FROM g GROUP BY analysis_id, run, kind")
def block_runs(spark, sf_dir):
    """Runs of equal kind."""
    order = Window.partitionBy("analysis_id").orderBy("seq")
    log = event_log(spark, sf_dir).withColumn("c", (~F.col("kind").eqNullSafe(F.lag("kind").over(order))).cast("int"))
    return log.withColumn("run", F.sum("c").over(order)).groupBy("analysis_id", "run", "kind").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 5")
def retention_prune(spark, sf_dir):
    """All but the newest of each workspace."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order)).where("r > 5").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority ILIKE '%URGENT%' ESCAPE '!' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 20")
def history_page(spark, sf_dir):
    """A page of the history, newest first."""
    hit = F.col("o_orderpriority").ilike("%URGENT%")
    return table(spark, sf_dir, "orders").where(hit).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(20).limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 8")
def top_per_group(spark, sf_dir):
    """Caps in a group."""
    return R.keep_best(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 8).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, regexp_replace(text, '(token|secret|password|api_key)( ?[=:] ?)\"?[A-Za-z0-9_-]{8,}\"?', '\\1\\2***', 'g') AS masked FROM documents WHERE regexp_matches(text, '(token|secret|password|api_key)( ?[=:] ?)\"?[A-Za-z0-9_-]{8,}\"?')")
def secret_scan_masked(spark, sf_dir):
    """Texts with a secret, masked."""
    pattern = '(token|secret|password|api_key)( ?[=:] ?)"?[A-Za-z0-9_-]{8,}"?'
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(pattern)).select("doc_id", F.regexp_replace("text", pattern, "$1$2***").alias("masked"))


@query("WITH c AS (SELECT page_id, unnest(string_split(url, '')) AS c FROM pages WHERE url IS NOT NULL), n AS (SELECT page_id, c, count(*) AS k FROM c WHERE c <> '' GROUP BY ALL), t AS (SELECT *, sum(k) OVER (PARTITION BY page_id) AS total FROM n) SELECT page_id, round(-sum(k / total * log2(k / total)), 6) AS entropy FROM t GROUP BY page_id")
def char_entropy(spark, sf_dir):
    """Entropy of the characters of a url."""
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split("url", "")).alias("c")).where("c <> ''").groupBy("page_id", "c").agg(F.count("*").alias("k"))
    share = F.col("k") / F.sum("k").over(Window.partitionBy("page_id"))
    return each.withColumn("p", share).groupBy("page_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(token|secret|password)') THEN 'secret' WHEN regexp_matches(text, '(?i)licensed? under') THEN 'license' WHEN regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+') THEN 'mail' WHEN contains(text, '%%%') THEN 'junk' END AS rule FROM documents")
def ordered_rule_match(spark, sf_dir):
    """The first of ordered patterns that matches."""
    found = None
    for name, pattern in (("secret", "(?i)(token|secret|password)"), ("license", "(?i)licensed? under"), ("mail", "[a-z0-9.]+@[a-z0-9.]+"), ("junk", "%%%")):
        hit = F.col("text").rlike(pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("rule"))


@query("WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL")
def html_sink_scan(spark, sf_dir):
    """SEC: tags of a page by name."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def markdown_escape(spark, sf_dir):
    """K3: escaped text."""
    return table(spark, sf_dir, "pages").select("page_id", X.markdown(F.col("html")).alias("escaped"))


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY l_linestatus")
def severity_kind_matrix(spark, sf_dir):
    """A pivot."""
    out = table(spark, sf_dir, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    return out.select("l_linestatus", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(DISTINCT l_suppkey) AS suppliers, bool_and(l_discount = 0) AS never_cut FROM lineitem GROUP BY l_orderkey")
def summary_counts(spark, sf_dir):
    """Conditional counts in one pass."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_distinct("l_suppkey").alias("suppliers"), F.bool_and(F.col("l_discount") == 0).alias("never_cut"))


@query("SELECT lang, source, count(*) AS n, sum(toxic) AS toxic, CAST(grouping(lang) AS INTEGER) AS g FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets_metrics(spark, sf_dir):
    """Six groupings in one pass."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.grouping("lang").cast("int").alias("g"))


@query("""WITH c AS (SELECT lang, count(*) FILTER (p AND toxic = 1) AS tp, count(*) FILTER (p AND toxic = 0) AS fp, count(*) FILTER (NOT p AND toxic = 1) AS fn FROM (SELECT lang, n_chars > 1500 AS p, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY lang)
 SELECT lang, tp, fp, fn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall FROM c""")
def confusion_prf(spark, sf_dir):
    """Precision and recall, null on nothing."""
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", F.col("n_chars") > 1500)
    c = both.groupBy("lang").agg(F.count_if(F.expr("p and toxic = 1")).alias("tp"), F.count_if(F.expr("p and toxic = 0")).alias("fp"), F.count_if(F.expr("not p and toxic = 1")).alias("fn"))
    return c.withColumns({"precision": X.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": X.ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, value AS p95 FROM r WHERE r = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1)")
def nearest_rank_p95(spark, sf_dir):
    """The value at the nearest rank; equal values are counted before the shuffle, and only counts are ordered."""
    by = Window.partitionBy("event_type")
    counts = table(spark, sf_dir, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("k"))
    ranked = counts.withColumns({"upto": F.sum("k").over(by.orderBy("value")), "n": F.sum("k").over(by)})
    rank = F.least("n", F.floor(0.95 * F.col("n")) + 1)
    return ranked.where((F.col("upto") >= rank) & (F.col("upto") - F.col("k") < rank)).select("event_type", F.col("value").alias("p95"))


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels), d AS (SELECT b, k, ((b * 1103515245 + k * 12345 + b * k * 7919) % 2147483648) % (SELECT count(*) FROM labels) AS i FROM range(200) t(b), range(100) u(k)),
 m AS (SELECT b, avg(CAST(toxic AS DOUBLE)) AS v FROM d JOIN p USING (i) GROUP BY b), r AS (SELECT v, row_number() OVER (ORDER BY v) AS r FROM m) SELECT round(min(v) FILTER (r = 5), 6) AS lo, round(min(v) FILTER (r = 195), 6) AS hi FROM r""")
def bootstrap_ci(spark, sf_dir):
    """A bootstrap interval by nearest rank, with arithmetic draws."""
    labels = table(spark, sf_dir, "labels")
    n = labels.count()
    cases = labels.select("toxic", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("i"))
    draws = spark.range(200).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))).alias("k"))
    draws = draws.withColumn("i", ((F.col("b") * 1103515245 + F.col("k") * 12345 + F.col("b") * F.col("k") * 7919) % 2147483648) % max(n, 1))
    means = draws.join(cases, "i").groupBy("b").agg(F.avg("toxic").alias("v")).withColumn("r", F.row_number().over(Window.orderBy("v")))
    return means.agg(F.round(F.min(F.when(F.col("r") == 5, F.col("v"))), 6).alias("lo"), F.round(F.min(F.when(F.col("r") == 195, F.col("v"))), 6).alias("hi"))


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customer', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'bag', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)")
def set_ops(spark, sf_dir):
    """Set and bag operations."""
    c, s = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    parts = {"both": c.intersect(s), "customer": c.subtract(s), "any": c.union(s).distinct(), "bag": c.exceptAll(s)}
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linestatus, l_extendedprice DESC, l_linenumber) AS INTEGER) AS place FROM lineitem")
def report_rank(spark, sf_dir):
    """The order of a report."""
    severity = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(severity, "l_linestatus", F.desc("l_extendedprice"), "l_linenumber")).alias("place"))


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_discount >= 0.05) AS fails, CASE WHEN bool_or(l_returnflag = 'R') THEN 'high' WHEN bool_or(l_returnflag = 'A') THEN 'medium' ELSE 'low' END AS priority FROM lineitem GROUP BY l_orderkey")
def gate(spark, sf_dir):
    """K6: does a report fail the gate, and its priority."""
    flag = F.col("l_returnflag")
    priority = F.when(F.bool_or(flag == "R"), "high").when(F.bool_or(flag == "A"), "medium").otherwise("low")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or((flag == "R") & (F.col("l_discount") >= 0.05)).alias("fails"), priority.alias("priority"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, length(props) AS size FROM events")
def json_props(spark, sf_dir):
    """Fields of a JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").cast("long").alias("size"))


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '([0-9]+)', 1), '') AS INTEGER) AS major, TRY_CAST(nullif(regexp_extract(p_name, '([0-9]+)', 1), '') AS INTEGER) AS other FROM part")
def major_version_change(spark, sf_dir):
    """A version's first number."""
    number = lambda c: F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", number("p_brand").alias("major"), number("p_name").alias("other"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '\\.html?([?#]|$)') THEN 'html' WHEN regexp_matches(url, '/([?#]|$)') THEN 'folder' ELSE 'other' END AS language FROM pages")
def suffix_language_map(spark, sf_dir):
    """Kinds by suffix."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(url.rlike(r"\.html?([?#]|$)"), "html").when(url.rlike("/([?#]|$)"), "folder").otherwise("other").alias("language"))


@query(f"WITH {LINES}, d AS (SELECT d.doc_id, regexp_extract_all(split_part(text, chr(10), 1), '[0-9]+') AS a, regexp_extract_all(text, '[0-9]+') AS b FROM documents d WHERE text IS NOT NULL) SELECT doc_id, len(list_distinct(b)) AS numbers, len(list_filter(list_distinct(b), lambda x: NOT list_contains(a, x))) AS unproven FROM d")
def claim_numbers(spark, sf_dir):
    """Numbers of a text that its first line doesn't have."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"), 1))
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.size(numbers(F.col("text"))).cast("long").alias("numbers"), F.size(F.array_except(numbers(F.col("text")), numbers(F.split("text", "\n")[0]))).cast("long").alias("unproven"))


@query("""WITH RECURSIVE f AS (SELECT CAST(l_orderkey AS VARCHAR) AS change_id, l_returnflag AS category, l_linestatus AS file, 'head' AS side, CAST(trunc(-l_extendedprice) AS BIGINT) AS ord, l_orderkey || '-' || l_linenumber AS id, CAST(trunc(l_quantity) AS BIGINT) AS lo, CAST(trunc(l_quantity) AS BIGINT) + 5 AS hi FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY change_id, category, file, side ORDER BY ord, id, lo, hi) AS r FROM f),
 g AS (SELECT n.*, id AS kept_id, [{'id': id, 'lo': lo, 'hi': hi}] AS kept FROM n WHERE r = 1
   UNION ALL SELECT n.*, coalesce(list_filter(g.kept, lambda x: x.lo <= n.hi AND n.lo <= x.hi)[1].id, n.id), CASE WHEN len(list_filter(g.kept, lambda x: x.lo <= n.hi AND n.lo <= x.hi)) = 0 THEN list_append(g.kept, {'id': n.id, 'lo': n.lo, 'hi': n.hi}) ELSE g.kept END
   FROM g JOIN n ON n.change_id = g.change_id AND n.category = g.category AND n.file = g.file AND n.side = g.side AND n.r = g.r + 1)
 SELECT change_id, category, file, side, ord, id, lo, hi, kept_id FROM g""")
def greedy_dedup(spark, sf_dir):
    """Findings merged into the first kept one that they overlap."""
    at = F.col("l_quantity").cast("long")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("change_id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("file"), F.lit("head").alias("side"), (-F.col("l_extendedprice")).cast("long").alias("ord"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), at.alias("lo"), (at + 5).alias("hi"))
    return matching.greedy_dedup(found)


@query()
def maximum_matching(spark, sf_dir):
    """Predictions to labels, one to one and as many as can be."""
    pairs = tolerant_overlap(spark, sf_dir)
    return matching.maximum_matching(pairs.select(F.col("l_orderkey").cast("string").alias("case_id"), F.concat(F.lit("p"), "pred").alias("pred_id"), F.concat(F.lit("l"), "label").alias("label_id")))
