"""Queries over documents, benchmark, labels, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import written
from ..operators import passages as ps
from ..operators import timeline
from ..operators.relational import connected_components, islands

LONG = 20


def docs(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def windows(spark, sf_dir) -> DataFrame:
    return ps.windows(docs(spark, sf_dir), "doc_id")


def matches(spark, sf_dir) -> DataFrame:
    return ps.matches(windows(spark, sf_dir))


TOKENS = r"""t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents)"""
WINDOWS = f"""{TOKENS}, u AS (SELECT doc_id AS doc, unnest(range(len(w) - 7)) AS pos, w FROM t WHERE len(w) >= 8),
x AS (SELECT doc, pos, array_to_string(w[pos + 1 : pos + 8], ' ') AS h FROM u)"""
SEEDS = f"""{WINDOWS}, k AS (SELECT h FROM x GROUP BY h HAVING count(*) BETWEEN 2 AND 256), y AS (SELECT x.* FROM x JOIN k ON x.h = k.h),
p AS (SELECT l.doc AS a, r.doc AS b, l.pos AS pa, r.pos AS pb FROM y l JOIN y r ON l.h = r.h AND l.doc < r.doc)"""
MATCHES = f"""{SEEDS}, i AS (SELECT *, pa - pb AS lag, pa - row_number() OVER (PARTITION BY a, b, pa - pb ORDER BY pa) AS k FROM p),
m AS (SELECT a, b, min(pa) AS a_start, max(pa) + 8 AS a_end, lag, max(pa) + 8 - min(pa) AS len FROM i GROUP BY a, b, lag, k)"""


def doc_tokens(spark, sf_dir):
    t = ps.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def doc_windows(spark, sf_dir):
    return windows(spark, sf_dir).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h1", "h2").alias("n_distinct"))


def bucket_sizes(spark, sf_dir):
    n = ps.bucket_sizes(windows(spark, sf_dir))
    size = F.least("n", F.lit(ps.MAX_BUCKET + 1))
    return n.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("windows"))


def seed_pairs(spark, sf_dir):
    return ps.seeds(windows(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def doc_matches(spark, sf_dir):
    return matches(spark, sf_dir)


def internal_repeats(spark, sf_dir):
    return ps.without_hosted(matches(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"))


INTERNAL = f"""WITH {MATCHES} SELECT a, b, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM m WHERE NOT EXISTS (
 SELECT 1 FROM m h WHERE h.a = m.a AND h.b = m.b AND h.len >= 60 AND h.a_start <= m.a_start AND m.a_end <= h.a_end
 AND h.a_start - h.lag <= m.a_start - m.lag AND m.a_end - m.lag <= h.a_end - h.lag AND abs(h.lag - m.lag) > 2 AND 2 * h.len >= 3 * m.len) GROUP BY ALL"""


def doc_votes(spark, sf_dir):
    return ps.votes(matches(spark, sf_dir).where(F.col("len") >= LONG))


VOTES = f"""WITH {MATCHES}, l AS (SELECT * FROM m WHERE len >= {LONG}),
v AS (SELECT a AS doc, a_start AS pos FROM l UNION ALL SELECT a, a_end FROM l UNION ALL SELECT b, a_start - lag FROM l UNION ALL SELECT b, a_end - lag FROM l)
SELECT doc, pos, count(*) AS n FROM v GROUP BY ALL"""


def doc_spanning(spark, sf_dir):
    m = written(linked(spark, sf_dir), "matches")  # read by the votes and by the sides
    return timeline.spanning(ps.votes(m), ps.sides(m), ["doc"], "pos", "start", "end", 3).select("doc", "pos", "n", F.col("n_spanning").cast("long").alias("n_spanning"))


SPANNING = f"""WITH {MATCHES}, l AS (SELECT * FROM m WHERE len >= {LONG}),
s AS (SELECT a AS doc, a_start AS s, a_end AS e FROM l UNION ALL SELECT b, a_start - lag, a_end - lag FROM l),
v AS (SELECT doc, s AS pos FROM s UNION ALL SELECT doc, e FROM s), c AS (SELECT doc, pos, count(*) AS n FROM v GROUP BY ALL)
SELECT doc, pos, n, (SELECT count(*) FROM s WHERE s.doc = c.doc AND s.s <= c.pos - 3) - (SELECT count(*) FROM s WHERE s.doc = c.doc AND s.e <= c.pos + 3) AS n_spanning FROM c"""


def linked(spark, sf_dir) -> DataFrame:
    return matches(spark, sf_dir).where(F.col("len") >= LONG)


def long_windows(spark, sf_dir) -> DataFrame:
    """doc, pos, head: the places of windows of LONG tokens that two documents or more hold, with the smallest such document.

    Two documents share a passage of LONG tokens exactly if they share such a window. Every document of a window meets
    its smallest one only, so that a passage of any number of copies costs as much as it has places; no window is left out.
    """
    w = ps.windows(docs(spark, sf_dir), "doc_id", size=LONG)
    shared = w.groupBy("h1", "h2").agg(F.min("doc").alias("head"), F.max("doc").alias("last")).where("head < last").select("h1", "h2", "head")
    return w.join(shared, ["h1", "h2"]).select("doc", "pos", "head")


def links(places: DataFrame) -> DataFrame:
    return connected_components(places.where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct())


def doc_components(spark, sf_dir):
    return links(long_windows(spark, sf_dir)).select(F.col("node").alias("doc_id"), F.col("component").alias("root"))


PLACES = f"""{TOKENS}, lu AS (SELECT doc_id AS doc, unnest(range(len(w) - {LONG - 1})) AS pos, w FROM t WHERE len(w) >= {LONG}),
lw AS (SELECT doc, pos, md5(array_to_string(w[pos + 1 : pos + {LONG}], ' ')) AS h FROM lu), lk AS (SELECT h, min(doc) AS head FROM lw GROUP BY h HAVING min(doc) < max(doc)),
lp AS (SELECT doc, pos, head FROM lw JOIN lk ON lw.h = lk.h)"""
COMPONENTS = f"""WITH RECURSIVE {PLACES}, e AS (SELECT DISTINCT head AS a, doc AS b FROM lp WHERE doc <> head), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, z) AS (SELECT DISTINCT a, a FROM g UNION SELECT r.n, g.b FROM r JOIN g ON g.a = r.z), c AS (SELECT n, min(z) AS root FROM r GROUP BY n)"""


def repeat_clusters(spark, sf_dir):
    """Flagship: clusters of documents that share long passages, with the number and lengths of the stretches that are shared."""
    places = written(long_windows(spark, sf_dir), "places")  # read by the components and by the stretches
    c = links(places)
    size = c.groupBy("component").agg(F.count(F.lit(1)).alias("n_docs"))
    found = islands(places.select("doc", "pos", (F.col("pos") + LONG).alias("end")), "pos", "end", ["doc"])
    stretches = found.groupBy("doc", "island").agg((F.max("end") - F.min("pos")).alias("len"))
    sums = stretches.join(c, stretches["doc"] == c["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("n_stretches"), F.sum("len").alias("total_len"), F.max("len").alias("max_len"))
    return size.join(sums, "component").withColumnRenamed("component", "root")


CLUSTERS = f"""{COMPONENTS}, s AS (SELECT root, count(*) AS n_docs FROM c GROUP BY ALL),
le AS (SELECT doc, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc ORDER BY pos) + {LONG} THEN 0 ELSE 1 END AS fresh FROM lp),
li AS (SELECT doc, pos, sum(fresh) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM le),
ll AS (SELECT doc, max(pos) + {LONG} - min(pos) AS len FROM li GROUP BY doc, island)
SELECT s.root, n_docs, count(*) AS n_stretches, CAST(sum(len) AS BIGINT) AS total_len, max(len) AS max_len
FROM ll JOIN c ON c.n = ll.doc JOIN s ON s.root = c.root GROUP BY ALL"""


def same_text_share(spark, sf_dir):
    """Pairs of documents by the share of the longer one's tokens that their longest common passage covers."""
    best = linked(spark, sf_dir).groupBy("a", "b").agg(F.max("len").alias("shared"))
    n = doc_tokens(spark, sf_dir).select("doc_id", "n_tokens")
    both = best.join(n.withColumnsRenamed({"doc_id": "a", "n_tokens": "na"}), "a").join(n.withColumnsRenamed({"doc_id": "b", "n_tokens": "nb"}), "b")
    longer, shorter = F.greatest("na", "nb"), F.least("na", "nb")
    same = (F.col("shared") >= 0.8 * longer) | ((longer < 160) & (F.col("shared") >= 0.8 * shorter))
    return both.select("a", "b", "shared", same.alias("same"))


SAME = f"""WITH {MATCHES}, n AS (SELECT doc_id, len(w) AS n FROM t), b AS (SELECT a, b, max(len) AS shared FROM m WHERE len >= {LONG} GROUP BY ALL)
SELECT b.a, b.b, shared, shared >= 0.8 * greatest(x.n, y.n) OR (greatest(x.n, y.n) < 160 AND shared >= 0.8 * least(x.n, y.n)) AS same
FROM b JOIN n x ON x.doc_id = b.a JOIN n y ON y.doc_id = b.b"""


def items(spark, sf_dir) -> DataFrame:
    return ps.listed(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs(spark, sf_dir))


def verdicts(spark, sf_dir):
    share = F.col("best") / F.greatest("n_tokens", F.lit(1))
    return items(spark, sf_dir).select(F.col("item").alias("item_id"), "n_tokens", "best", ps.verdict(share).alias("verdict"))


ITEMS = rf"""{WINDOWS}, bt AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
bu AS (SELECT item_id, unnest(range(len(w) - 7)) AS pi, w FROM bt WHERE len(w) >= 8), bx AS (SELECT item_id, pi, array_to_string(w[pi + 1 : pi + 8], ' ') AS h FROM bu),
j AS (SELECT item_id, doc, pos - pi AS lag, pi FROM bx JOIN x ON x.h = bx.h), ji AS (SELECT *, pi - row_number() OVER (PARTITION BY item_id, doc, lag ORDER BY pi) AS k FROM j),
jb AS (SELECT item_id, max(n) + 7 AS best FROM (SELECT item_id, doc, lag, k, count(*) AS n FROM ji GROUP BY ALL) GROUP BY item_id),
v AS (SELECT bt.item_id, len(w) AS n_tokens, coalesce(best, 0) AS best, coalesce(best, 0) / greatest(len(w), 1) AS share FROM bt LEFT JOIN jb ON jb.item_id = bt.item_id)"""
VERDICTS = f"WITH {ITEMS} SELECT item_id, n_tokens, best, CASE WHEN share >= 0.9 THEN 'found' WHEN share >= 0.5 THEN 'short' WHEN share > 0 THEN 'fragment' ELSE 'missing' END AS verdict FROM v"


def recall(spark, sf_dir):
    share = F.col("best") / F.greatest("n_tokens", F.lit(1))
    return items(spark, sf_dir).agg(F.count(F.lit(1)).alias("items"), F.count_if(share >= 0.9).alias("found"), F.count_if((share >= 0.5) & (share < 0.9)).alias("partial"), F.sum("best").alias("covered_tokens"))


RECALL = f"WITH {ITEMS} SELECT count(*) AS items, count(*) FILTER (share >= 0.9) AS found, count(*) FILTER (share >= 0.5 AND share < 0.9) AS partial, CAST(sum(best) AS BIGINT) AS covered_tokens FROM v"


def levels(spark, sf_dir):
    """How many items are covered to each level or more."""
    pct = F.floor(100 * F.col("best") / F.greatest("n_tokens", F.lit(1))).cast("long")
    rows = items(spark, sf_dir).select(F.explode(F.filter(F.array(*[F.lit(x).cast("long") for x in (100, 95, 90, 80, 50)]), lambda x: x <= pct)).alias("level"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("items"))


LEVELS = f"WITH {ITEMS} SELECT l AS level, count(*) AS items FROM v, (SELECT unnest([100, 95, 90, 80, 50])::BIGINT AS l) WHERE floor(100 * best / greatest(n_tokens, 1)) >= l GROUP BY ALL"


def flag_share(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = d.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("flagged"))
    return rows.withColumn("share", F.round(F.col("flagged") / F.col("n"), 9))


FLAGS = "SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS flagged, round(count(*) FILTER (toxic = 1) / count(*), 9) AS share FROM documents JOIN labels USING (doc_id) GROUP BY ALL"


def conv_words(spark, sf_dir):
    """Conversations with the same sequence of roles are one word."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    word = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ">")
    return c.groupBy("conv_id").agg(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


CONV_WORDS = "SELECT word, count(*) AS n FROM (SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS word FROM conversations GROUP BY ALL) GROUP BY ALL"


def conv_followed(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    n = c.withColumn("nxt", F.lead("role").over(w)).where("nxt is not null").groupBy("role", "nxt").agg(F.count(F.lit(1)).alias("n"))
    size = c.groupBy("role").agg(F.count(F.lit(1)).alias("size"))
    return n.join(size, "role").select("role", "nxt", "n", (F.col("n") >= 0.7 * F.col("size")).alias("firm"))


CONV_FOLLOWED = """WITH l AS (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations), z AS (SELECT role, count(*) AS size FROM conversations GROUP BY ALL)
SELECT l.role, nxt, count(*) AS n, count(*) >= 0.7 * any_value(size) AS firm FROM l JOIN z ON z.role = l.role WHERE nxt IS NOT NULL GROUP BY ALL"""


def page_names(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pattern = r"^(https?)://([^/]+)/([a-z]+)/(\d+)"
    part = lambda k: F.regexp_extract("url", pattern, k)
    return p.select("page_id", part(1).alias("scheme"), part(2).alias("host"), part(3).alias("lang"), F.when(part(4) != "", part(4).cast("long")).alias("number"))


PAGES = r"""WITH r AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\d+)', ['scheme', 'host', 'lang', 'n']) AS x FROM pages)
SELECT page_id, x.scheme AS scheme, x.host AS host, x.lang AS lang, TRY_CAST(x.n AS BIGINT) AS number FROM r"""


QUERIES = {
    "doc_tokens": (doc_tokens, f"WITH {TOKENS} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM t"),
    "doc_windows": (doc_windows, f"WITH {WINDOWS} SELECT doc, count(*) AS n, count(DISTINCT h) AS n_distinct FROM x GROUP BY ALL"),
    "doc_bucket_sizes": (bucket_sizes, f"WITH {WINDOWS}, n AS (SELECT h, count(*) AS n FROM x GROUP BY ALL) SELECT least(n, 257) AS size, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS windows FROM n GROUP BY ALL"),
    "doc_seed_pairs": (seed_pairs, f"WITH {SEEDS} SELECT a, b, count(*) AS n FROM p GROUP BY ALL"),
    "doc_matches": (doc_matches, f"WITH {MATCHES} SELECT a, b, a_start, a_end, lag, len FROM m"),
    "doc_internal_repeats": (internal_repeats, INTERNAL),
    "doc_votes": (doc_votes, VOTES),
    "doc_spanning": (doc_spanning, SPANNING),
    "doc_components": (doc_components, f"{COMPONENTS} SELECT n AS doc_id, root FROM c"),
    "doc_repeat_clusters": (repeat_clusters, CLUSTERS),
    "doc_same_text_share": (same_text_share, SAME),
    "bench_verdicts": (verdicts, VERDICTS),
    "bench_recall": (recall, RECALL),
    "bench_per_item_levels": (levels, LEVELS),
    "label_flag_share": (flag_share, FLAGS),
    "conv_words": (conv_words, CONV_WORDS),
    "conv_followed": (conv_followed, CONV_FOLLOWED),
    "page_name_parse": (page_names, PAGES),
}
