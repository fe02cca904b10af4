"""The library's operators as named queries over the standard tables, with SQL that gives the same rows.

A query takes the session and a folder of tables. Papers, citations, drafts and decisions are read from the business
tables by the mappings that each query states; texts that those tables cannot hold are built from their columns
and parsed back, so that the SQL side never parses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import unicode as U
from quillspark.operators import decide, discover, graph, keys, matching, ranking, reconcile, triage
from quillspark.shipping import ship
from quillspark.sources import files, landed, pages
from quillspark.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        wide = self.spark.sparkContext.defaultParallelism
        if name in ("documents", "pages") and len(df.inputFiles()) == 1 and df._jdf.queryExecution().toRdd().getNumPartitions() < wide:
            return df.repartition(wide)  # long texts in one row group would be one task
        return df


def query(sql: str | None = None):
    """Registers a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, folder))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


c, lit = F.col, F.lit


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def cites(t: Tables) -> DataFrame:
    return t.lineitem.select(c("l_orderkey").alias("stem"), c("l_partkey").alias("cited")).distinct()


def keyed_orders(t: Tables) -> DataFrame:
    """Papers: an order by its customer's nation and year."""
    who = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    return t.orders.join(who, c("o_custkey") == c("c_custkey")).select("o_orderkey", "o_custkey", "n_name", F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderstatus", "o_totalprice")


_CITES = "cites AS (SELECT DISTINCT l_orderkey AS stem, l_partkey AS cited FROM lineitem)"
_PAIRS = f"{_CITES}, pairs AS (SELECT x.stem AS a, y.stem AS b, count(*) AS shared FROM cites x JOIN cites y ON x.cited = y.cited AND x.stem < y.stem GROUP BY 1, 2 HAVING count(*) >= 2)"
_LABEL = f"""{_PAIRS}, ends AS (SELECT a AS stem, b AS other, shared FROM pairs UNION ALL SELECT b, a, shared FROM pairs),
lab AS (SELECT e.*, CASE WHEN EXISTS (SELECT 1 FROM cites c WHERE c.stem = e.other AND c.cited = e.stem) THEN 'cites this'
  WHEN EXISTS (SELECT 1 FROM cites c WHERE c.stem = e.stem AND c.cited = e.other) THEN 'cited here' ELSE '' END AS note FROM ends e)"""
_PAPERS = "papers AS (SELECT o_orderkey, o_custkey, n_name, year(o_orderdate) AS year, o_orderpriority, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"

# ---------------------------------------------------------------- graph


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def j08_coupling(t):
    """Pairs of orders with two or more parts in common."""
    return graph.coupling(cites(t))


@query(f"WITH {_LABEL} SELECT * FROM lab")
def j09_direct_labels(t):
    own = t.orders.select(c("o_orderkey").alias("stem"), c("o_orderkey").alias("doi"))
    return graph.labelled(graph.coupling(cites(t)), cites(t), own)


@query(f"WITH {_PAIRS}, ends AS (SELECT a AS stem, b AS other, shared FROM pairs UNION ALL SELECT b, a, shared FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY shared DESC, other) AS rank FROM ends) SELECT * FROM r")
def o01_coupled_ranking(t):
    p = graph.coupling(cites(t))
    both = p.select(c("a").alias("stem"), c("b").alias("other"), "shared").unionByName(p.select(c("b").alias("stem"), c("a").alias("other"), "shared"))
    return graph.ranked(both, ["stem"], [("shared", True), "other"])


@query(f"WITH {_PAIRS} SELECT shared, count(*) AS n FROM pairs GROUP BY 1")
def a15_shared_histogram(t):
    return graph.coupling(cites(t)).groupBy("shared").agg(F.count(lit(1)).alias("n"))


@query(f"WITH {_CITES}, seeds AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT') SELECT DISTINCT seed, cited AS other, 'out' AS direction FROM cites JOIN seeds ON stem = seed UNION SELECT DISTINCT seed, stem, 'in' FROM cites JOIN seeds ON cited = seed")
def j22_seed_neighbours(t):
    seeds = t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("stem"))
    return graph.neighbours(seeds, cites(t))


@query(f"WITH {_CITES}, seeds AS (SELECT o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT'), n AS (SELECT seed, cited AS other FROM cites JOIN seeds ON stem = seed UNION SELECT seed, stem FROM cites JOIN seeds ON cited = seed) SELECT other, count(DISTINCT seed) AS seeds FROM n GROUP BY 1")
def a06_distinct_seeds(t):
    seeds = t.orders.where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("stem"))
    return graph.neighbours(seeds, cites(t)).select("other", "seed").distinct().groupBy("other").agg(F.count(lit(1)).alias("seeds"))


@query("WITH r AS (SELECT l_orderkey AS seed, l_partkey AS other, l_extendedprice AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) SELECT * FROM r WHERE rank <= 3")
def w08_top_per_seed(t):
    x = graph.top(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3)
    return x.select(c("l_orderkey").alias("seed"), c("l_partkey").alias("other"), c("l_extendedprice").alias("weight"), "rank")


# ---------------------------------------------------------------- identifiers and keys

_TOKEN = "CASE page_id % 5 WHEN 0 THEN ' pmc' || page_id WHEN 1 THEN page_id::VARCHAR WHEN 2 THEN '10.1000/p' || page_id || ' ' WHEN 3 THEN 'Title ' || page_id ELSE 'https://doi.org/10.1/' || page_id END"


def tokens(t: Tables) -> DataFrame:
    i = c("page_id")
    return t.pages.select(i, F.when(i % 5 == 0, text_of(" pmc", i)).when(i % 5 == 1, text_of(i)).when(i % 5 == 2, text_of("10.1000/p", i, " ")).when(i % 5 == 3, text_of("Title ", i)).otherwise(text_of("https://doi.org/10.1/", i)).alias("token"))


@query(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pmcid' WHEN 1 THEN 'pmid' WHEN 2 THEN 'doi' ELSE 'title' END AS kind, CASE WHEN page_id % 5 = 0 THEN 'PMC' || page_id ELSE trim({_TOKEN}) END AS value FROM pages")
def p05_identifier_kind(t):
    return tokens(t).select("page_id", T.identifier_kind(c("token")).alias("kind"), T.identifier_value(c("token")).alias("value"))


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'PMCID:PMC' || page_id WHEN 1 THEN 'EXT_ID:' || page_id || ' AND SRC:MED' WHEN 2 THEN 'DOI:"10.1000/p' || page_id || '"' ELSE 'TITLE:"' || trim({_TOKEN}) || '"' END AS query FROM pages""")
def p06_literature_query(t):
    k = tokens(t).select("page_id", T.identifier_kind(c("token")).alias("kind"), T.identifier_value(c("token")).alias("value"))
    return k.select("page_id", T.literature_query(c("kind"), c("value")).alias("query"))


@query(f"WITH {_PAPERS} SELECT o_orderkey, coalesce(nullif(regexp_replace(lower(split_part(n_name, ' ', 1)), '[^a-z0-9]', '', 'g'), ''), 'anon') || coalesce(year::VARCHAR, '0000') AS base FROM papers")
def p07_base_key(t):
    return keyed_orders(t).select("o_orderkey", T.base_key(text_of(c("n_name"), " A.B., Other C"), c("year").cast("string")).alias("base"))


@query(f"""WITH {_PAPERS}, b AS (SELECT o_orderkey, regexp_replace(lower(split_part(n_name, ' ', 1)), '[^a-z0-9]', '', 'g') || year AS base FROM papers),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS n FROM b) SELECT o_orderkey, CASE WHEN n = 1 THEN base WHEN n <= 27 THEN base || chr(95 + n::INT) ELSE base || n END AS key FROM n""")
def w01_key_suffixes(t):
    b = keyed_orders(t).select("o_orderkey", T.base_key(c("n_name"), c("year").cast("string")).alias("base"))
    return keys.assign_keys(b, "base", ["o_orderkey"]).select("o_orderkey", "key")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'd' || o_custkey END AS doi, 'p' || o_orderkey AS pmid, 'c' || o_custkey AS pmcid FROM orders),
ids AS (SELECT 'd' || user_id AS id, 's' || event_id AS stem, event_id AS pos FROM events UNION ALL SELECT 'p' || l_orderkey, 't' || l_linenumber, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'c' || c_custkey, 'u' || c_nationkey, c_custkey FROM customer),
one AS (SELECT id, arg_max(stem, pos) AS stem FROM ids GROUP BY 1)
SELECT o_orderkey, coalesce(a.stem, b.stem, c.stem) AS stem FROM r LEFT JOIN one a ON r.doi = a.id LEFT JOIN one b ON r.pmid = b.id LEFT JOIN one c ON r.pmcid = c.id""")
def j01_priority_lookup(t):
    """Orders as records: a customer's number as doi (urgent orders have none), the order's as pmid; events, returned lines and customers as identifiers."""
    doi = F.when(c("o_orderpriority") == "1-URGENT", "").otherwise(text_of("d", c("o_custkey")))
    r = t.orders.select("o_orderkey", doi.alias("doi"), text_of("p", c("o_orderkey")).alias("pmid"), text_of("c", c("o_custkey")).alias("pmcid"))
    known = lambda d, id, stem, pos: d.select(text_of(*id).alias("id"), text_of(*stem).alias("stem"), c(pos).cast("bigint").alias("pos"))
    ids = known(t.events, ("d", c("user_id")), ("s", c("event_id")), "event_id")
    ids = ids.unionByName(known(t.lineitem.where("l_returnflag = 'R'"), ("p", c("l_orderkey")), ("t", c("l_linenumber")), "l_linenumber"))
    ids = ids.unionByName(known(t.customer, ("c", c("c_custkey")), ("u", c("c_nationkey")), "c_custkey"))
    return keys.resolve_identifiers(r, ids).select("o_orderkey", "stem")


@query("""WITH a AS (SELECT l_partkey AS doi, arg_max(l_orderkey, (l_orderkey, l_linenumber)) AS stem FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_partkey AS doi, arg_min(l_orderkey, (l_orderkey, l_linenumber)) AS stem FROM lineitem GROUP BY 1)
SELECT 'd' || b.doi AS doi, 's' || coalesce(a.stem, b.stem) AS stem FROM b LEFT JOIN a USING (doi)""")
def a18_id_map(t):
    x = t.lineitem.select(text_of("D", c("l_partkey")).alias("id"), text_of("d", c("l_partkey")).alias("doi"), text_of("s", c("l_orderkey")).alias("stem"), (c("l_orderkey") * 100 + c("l_linenumber")).alias("pos"), "l_returnflag")
    return keys.id_map(x.where("l_returnflag = 'R'").select("id", "stem", "pos"), x.select("doi", "stem", "pos"))


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE role IS NOT NULL AND trim(role) <> '' GROUP BY 1, 2")
def w02_ordered_dedup(t):
    x = t.conversations.select("conv_id", "turn", F.when(c("turn") % 2 == 0, F.upper("role")).otherwise(text_of(" ", c("role"), " ")).alias("role"))
    return keys.first_spellings(x, ["conv_id"], "role", "turn").select("conv_id", F.lower("role").alias("role"), "turn")


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def a07_ordered_list(t):
    return keys.ordered_list(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], "role", "turn", "l").select("conv_id", F.array_join("l", ">").alias("roles"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list_append(list(o_orderpriority), '1-URGENT'))), ',') AS projects FROM orders GROUP BY 1")
def u08_append_once(t):
    x = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return x.select("o_custkey", F.array_join(F.array_sort(keys.append_once(c("p"), lit("1-URGENT"))), ",").alias("projects"))


@query("WITH w AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS following FROM conversations) SELECT role, following, count(*) AS n FROM w WHERE following IS NOT NULL GROUP BY 1, 2")
def w04_adjacent_pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return t.conversations.withColumn("following", F.lead("role").over(w)).where("following is not null").groupBy("role", "following").agg(F.count(lit(1)).alias("n"))


@query("SELECT conv_id, arg_max(role, turn) AS last_role, arg_min(role, turn) AS first_role FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) GROUP BY 1")
def w07_first_and_last(t):
    one = t.conversations.groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    return one.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.min_by("role", "turn").alias("first_role"))


# ---------------------------------------------------------------- membership and selection


def projects(t: Tables) -> DataFrame:
    return t.orders.groupBy(c("o_custkey").alias("stem")).agg(F.collect_set("o_orderpriority").alias("projects"), F.collect_set(F.when(c("o_orderstatus") == "F", c("o_orderkey"))).alias("cited"))


@query("SELECT DISTINCT o_custkey AS stem FROM orders WHERE o_orderpriority = '2-HIGH'")
def p01_project_members(t):
    return projects(t).where(F.array_contains("projects", "2-HIGH")).select("stem")


@query("SELECT o_custkey AS stem FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '2-HIGH') AND NOT bool_or(o_orderstatus = 'F')")
def p02_members_without_references(t):
    return projects(t).where(F.array_contains("projects", "2-HIGH") & (c("cited").isNull() | (F.size("cited") == 0))).select("stem")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P'")
def p03_citeable(t):
    return t.orders.where(decide.citeable(F.when(c("o_orderstatus") == "P", "novelty_screen").when(c("o_orderstatus") == "F", "methods"))).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def p04_screening_corpus(t):
    return t.orders.where(~decide.citeable(F.when(c("o_orderstatus") == "P", "novelty_screen"))).select("o_orderkey")


@query("SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'publisher refused' WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'no full text at Europe PMC or NCBI efetch, and no OA copy via Unpaywall' WHEN page_id % 5 <> 0 THEN 'no legal OA copy (paywalled)' ELSE 'no DOI and not in Europe PMC' END AS reason FROM pages")
def p10_gap_reason(t):
    i = c("page_id")
    return t.pages.select("page_id", decide.gap_reason(F.when(i % 7 == 0, "publisher refused"), i % 2 == 0, F.when(i % 3 == 0, "PMC1").otherwise(""), F.when(i % 5 != 0, "10.1/x").otherwise("")).alias("reason"))


@query("""WITH a AS (SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber) FILTER (l_returnflag = 'A') AS x, list(l_partkey ORDER BY l_linenumber) FILTER (l_returnflag = 'R') AS y FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN len(x) > 0 THEN 'jats' WHEN len(y) > 0 THEN 'crossref' ELSE 'none' END AS source, coalesce(CASE WHEN len(x) > 0 THEN len(x) WHEN len(y) > 0 THEN len(y) END, 0) AS n FROM a""")
def p11_reference_cascade(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(c("l_returnflag") == "A", c("l_partkey").cast("string"))).alias("x"), F.collect_list(F.when(c("l_returnflag") == "R", c("l_partkey").cast("string"))).alias("y"))
    return t.orders.join(lists, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", decide.first_references(jats=c("x"), crossref=c("y")).alias("r")).select("o_orderkey", "r.source", F.size("r.refs").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'europepmc-jats' WHEN page_id % 3 = 0 THEN 'unpaywall-pdf' WHEN page_id % 5 = 0 THEN 'ncbi-efetch-jats' END AS route FROM pages")
def p12_fulltext_route(t):
    i = c("page_id")
    return t.pages.select("page_id", decide.fulltext_route(i % 4 == 0, i % 3 == 0, i % 5 == 0).alias("route"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'explicit' WHEN page_id % 3 = 0 THEN 'scraped' WHEN page_id % 5 = 0 THEN 'title-search' ELSE 'manual' END AS method, CASE WHEN page_id % 4 = 0 THEN '10.1/a' WHEN page_id % 3 = 0 THEN '10.1/b' WHEN page_id % 5 = 0 THEN '10.1/c' END AS doi FROM pages")
def p13_identity_cascade(t):
    i = c("page_id")
    r = decide.identified(F.when(i % 4 == 0, "10.1/a"), F.when(i % 3 == 0, "10.1/b"), lit("10.1/c"), lit("calcium waves in astrocytes"), F.when(i % 5 == 0, "astrocytes show calcium signals").otherwise("calcium only"))
    return t.pages.select("page_id", r.alias("r")).select("page_id", "r.method", "r.doi")


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'first ' || page_id WHEN page_id % 2 = 0 THEN 'second ' || page_id END AS title FROM pages")
def p14_metadata_cascade(t):
    i = c("page_id")
    a = F.when(i % 7 != 9, F.struct(F.when(i % 3 != 0, text_of("first ", i)).otherwise("").alias("title")))
    b = F.when(i % 2 == 0, F.struct(text_of("second ", i).alias("title")))
    return t.pages.select("page_id", decide.metadata(a, b).alias("m")).select("page_id", "m.title")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2001 WHEN event_id % 3 = 0 THEN 2002 WHEN event_id % 5 = 0 THEN 2003 WHEN event_id % 7 = 0 THEN 2004 END AS year FROM events")
def p15_year_cascade(t):
    i = c("event_id")
    part = lambda name, n, y: F.when(i % n == 0, lit(f'"{name}":{{"date-parts":[[{y},1]]}},')).otherwise("")
    payload = F.concat(lit('{"message":{'), part("created", 7, 2004), part("issued", 5, 2003), part("published-online", 3, 2002), part("published-print", 2, 2001), lit('"type":"x"}}'))
    return t.events.select("event_id", landed.publication_year(F.from_json(payload, landed.MESSAGE)["message"]).alias("year"))


@query("SELECT o_custkey AS doi, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS title, max(o_orderkey) AS cites FROM orders GROUP BY 1")
def p16_preserve_first(t):
    o = t.orders
    hits = o.select(c("o_custkey").alias("doi"), lit("A").alias("mode"), c("o_orderkey").alias("seed"), lit("out").alias("direction"), lit(None).cast("string").alias("query"), c("o_orderkey").alias("pos"), F.when(c("o_orderstatus") == "O", "").otherwise(c("o_orderstatus")).alias("title"), lit("").alias("author"), lit("").alias("year"), lit("").alias("venue"), c("o_orderkey").alias("cites"))
    return discover.merge_candidates(hits).select("doi", "title", "cites")


@query("SELECT page_id, page_id % 3 < 2 AS looks FROM pages")
def p17_citation_group(t):
    i = c("page_id")
    x = F.when(i % 3 == 0, text_of("Smith et al. 20", F.lpad((i % 100).cast("string"), 2, "0"), "; x")).when(i % 3 == 1, text_of("see 10.1234/abc", i)).otherwise(text_of("0.", i, "–0.9"))
    return t.pages.select("page_id", T.cites_something(x).alias("looks"))


@query("SELECT doc_id, doc_id % 3 = 0 AS valid FROM documents")
def p18_article_validity(t):
    i = c("doc_id")
    xml = F.when(i % 3 == 0, text_of("<!DOCTYPE article><article><a>", i, "</a></article>")).when(i % 3 == 1, "<other/>").otherwise("<article><a></article>")
    return t.documents.select("doc_id", U.article_xml(xml.cast("binary"))["valid"].alias("valid"))


@query("SELECT o_orderkey AS stem, count(l_partkey) AS n, count(l_partkey) FILTER (l_partkey % 3 <> 0) AS present, count(l_partkey) > 0 AND count(l_partkey) = count(l_partkey) FILTER (l_partkey % 3 <> 0) AS complete FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p19_all_files(t):
    papers = t.orders.join(t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("files")), c("o_orderkey") == c("l_orderkey"), "left").select(c("o_orderkey").alias("stem"), "files")
    return decide.all_files(papers, t.part.where("p_partkey % 3 <> 0").select(c("p_partkey").alias("name")))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN true ELSE false END AS braces FROM part")
def p20_needs_braces(t):
    i = c("p_partkey")
    token = F.when(i % 4 == 0, text_of("NMDA", i)).when(i % 4 == 1, text_of("Ca", i)).when(i % 4 == 2, "Alzheimer's").otherwise(F.lower("p_name"))
    return t.part.select("p_partkey", T.needs_braces(token, lit("wave")).alias("braces"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(year(l_shipdate) - year(o_orderdate)) <= 1")
def p22_year_slack(t):
    x = t.lineitem.join(t.orders, c("l_orderkey") == c("o_orderkey"))
    return x.where(F.abs(F.year("l_shipdate") - F.year("o_orderdate")) <= 1).select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT source, source <> '' AS safe FROM documents UNION SELECT DISTINCT source || '/x', false FROM documents")
def p23_safe_names(t):
    s = t.documents.select("source").distinct()
    both = s.unionByName(s.select(F.concat("source", lit("/x")).alias("source")))
    return both.select("source", decide.safe_name(c("source")).alias("safe"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'needs-id' WHEN doc_id % 7 = 0 THEN 'unresolved' WHEN quality IS NOT NULL AND doc_id % 2 = 0 THEN 'skip' WHEN quality IS NOT NULL THEN 'replaced' ELSE 'ingested' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def p25_ingest_outcome(t):
    i = c("doc_id")
    x = t.documents.join(t.labels, "doc_id", "left")
    return x.select("doc_id", decide.ingest_outcome(F.when(i % 11 == 0, "").otherwise("10.1/x"), F.when(i % 7 == 0, "").otherwise("t"), c("quality").cast("string"), i % 2 == 0, lit(False)).alias("outcome"))


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'needs-id' WHEN doc_id % 7 = 0 THEN 'unresolved' WHEN quality IS NOT NULL AND doc_id % 2 = 0 THEN 'skip' WHEN quality IS NOT NULL THEN 'replaced' ELSE 'ingested' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def a22_ingest_totals(t):
    return QUERIES["p25_ingest_outcome"](t.spark, t.folder).groupBy("outcome").agg(F.count(lit(1)).alias("n"))


@query("SELECT doc_id, contains(upper(text), 'THE') AS verdict FROM documents")
def p26_verdict(t):
    return t.documents.select("doc_id", decide.wants_reading(F.replace(F.upper("text"), lit("THE"), lit("investigate"))).alias("verdict"))


# ---------------------------------------------------------------- joins


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def j02_not_in_library(t):
    have = t.lineitem.where("l_returnflag = 'R'").select(T.doi_without_resolver(text_of("https://doi.org/10.1/P", c("l_partkey"))).alias("doi"))
    return t.part.withColumn("doi", T.doi_without_resolver(text_of(" 10.1/p", c("p_partkey")))).join(have, "doi", "left_anti").select("p_partkey")


def artefacts(t: Tables) -> tuple[DataFrame, ...]:
    s = lambda d, k: d.select(c(k).alias("stem"))
    return s(t.documents, "doc_id"), s(t.embeddings, "vec_id"), s(t.pages.withColumn("page_id", c("page_id") + 500), "page_id"), s(t.labels, "doc_id")


_DRIFT = """m AS (SELECT doc_id AS stem FROM documents), x AS (SELECT vec_id AS stem FROM embeddings), p AS (SELECT page_id + 500 AS stem FROM pages), n AS (SELECT doc_id AS stem FROM labels),
drift AS (SELECT 'missing_files' AS category, stem FROM m WHERE stem NOT IN (SELECT stem FROM x) AND stem NOT IN (SELECT stem FROM p)
 UNION ALL SELECT 'pdf_only', stem FROM m WHERE stem NOT IN (SELECT stem FROM x) AND stem IN (SELECT stem FROM p)
 UNION ALL SELECT 'missing_nodes', stem FROM m WHERE stem NOT IN (SELECT stem FROM n)
 UNION ALL SELECT 'orphan_xml', stem FROM x WHERE stem NOT IN (SELECT stem FROM m) UNION ALL SELECT 'orphan_nodes', stem FROM n WHERE stem NOT IN (SELECT stem FROM m))"""


@query(f"WITH {_DRIFT} SELECT * FROM drift")
def j03_drift(t):
    return reconcile.drift(*artefacts(t))


@query(f"WITH {_DRIFT} SELECT count(*) FILTER (category = 'missing_files') AS missing_files, count(*) FILTER (category = 'pdf_only') AS pdf_only, count(*) FILTER (category = 'missing_nodes') AS missing_nodes, count(*) FILTER (category = 'orphan_xml') AS orphan_xml, count(*) FILTER (category = 'orphan_nodes') AS orphan_nodes, count(*) FILTER (category <> 'pdf_only') = 0 AS is_clean FROM drift")
def a05_drift_summary(t):
    return reconcile.drift_summary(reconcile.drift(*artefacts(t)))


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus = 'F' LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def j04_lookup_chain(t):
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    cu = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name")
    return t.lineitem.join(o, c("l_orderkey") == c("o_orderkey"), "left").join(cu, c("o_custkey") == c("c_custkey"), "left").select("l_orderkey", "l_linenumber", "o_custkey", "c_name")


@query(f"WITH {_PAPERS}, lib AS (SELECT n_name, year, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS stems, count(*) AS n FROM papers WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2), ask AS (SELECT DISTINCT n_name, year FROM papers) SELECT n_name, year, coalesce(n, 0) AS n, stems FROM ask LEFT JOIN lib USING (n_name, year)")
def j05_author_year(t):
    p = keyed_orders(t)
    lib = p.where("o_orderpriority = '1-URGENT'").groupBy("n_name", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("stems"), F.count(lit(1)).alias("n"))
    return p.select("n_name", "year").distinct().join(lib, ["n_name", "year"], "left").select("n_name", "year", F.coalesce("n", lit(0)).alias("n"), "stems")


@query(f"WITH {_PAPERS} SELECT n_name, year, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS stems FROM papers GROUP BY 1, 2")
def a17_stems_by_author_year(t):
    return keyed_orders(t).groupBy("n_name", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("stems"))


_REFS = """said AS (SELECT n_name AS surname, year::VARCHAR AS year, count(*) AS n FROM papers WHERE o_orderstatus = 'O' GROUP BY 1, 2),
refs AS (SELECT n_name AS surname, year::VARCHAR AS year, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_orderkey END, o_orderkey) FILTER (o_orderkey % 2 = 0) AS doi, bool_or(o_orderpriority = '5-LOW') AS unverified FROM papers WHERE o_orderstatus = 'P' GROUP BY 1, 2)"""


def merged(t: Tables) -> DataFrame:
    p = keyed_orders(t).select(c("n_name").alias("surname"), c("year").cast("string").alias("year"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    said = p.where("o_orderstatus = 'O'").groupBy("surname", "year").agg(F.count(lit(1)).alias("n"))
    refs = p.where("o_orderstatus = 'P'").select("surname", "year", F.when(c("o_orderkey") % 2 == 0, text_of("d", c("o_orderkey"))).otherwise("").alias("doi"), lit("").alias("title"), (c("o_orderpriority") == "5-LOW").alias("unverified"), c("o_orderkey").alias("pos"))
    return reconcile.merge_citations(said, refs)


@query(f"WITH {_PAPERS}, {_REFS} SELECT coalesce(s.surname, r.surname) AS surname, coalesce(s.year, r.year) AS year, coalesce(s.n, 0)::BIGINT AS intext, r.surname IS NOT NULL AS in_reflist, r.doi, coalesce(r.unverified, false) AS unverified FROM said s FULL JOIN refs r ON s.surname = r.surname AND s.year = r.year")
def j06_mentions_and_references(t):
    return merged(t).drop("title")


@query(f"WITH {_PAPERS} SELECT n_name AS surname, year::VARCHAR AS year, arg_min(CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_orderkey END, o_orderkey) FILTER (o_orderkey % 2 = 0) AS doi, bool_or(o_orderpriority = '5-LOW') AS unverified FROM papers WHERE o_orderstatus = 'P' GROUP BY 1, 2")
def a19_reference_merge(t):
    return merged(t).where("in_reflist").select("surname", "year", "doi", "unverified")


@query("SELECT coalesce(o_custkey, c_custkey) AS key, coalesce(n, 0) AS intext, c_custkey IS NOT NULL AS in_list FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) FULL JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def j07_keys_and_items(t):
    said = t.orders.where("o_orderstatus = 'P'").groupBy(c("o_custkey").alias("key")).agg(F.count(lit(1)).alias("n"))
    items = t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("key"), lit(True).alias("i"))
    return said.join(items, "key", "full").select("key", F.coalesce("n", lit(0)).alias("intext"), F.coalesce("i", lit(False)).alias("in_list"))


_ASOF = """e AS (SELECT event_id, user_id, ts, event_type FROM events), j10 AS (SELECT m.event_id, m.user_id, (SELECT max_by(h.event_id, (h.ts, h.event_id)) FROM e h WHERE h.event_type = 'signup' AND h.user_id = m.user_id AND (h.ts, h.event_id) <= (m.ts, m.event_id)) AS section FROM e m)"""


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def j10_section_as_of(t):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    heads = e.where("event_type = 'signup'").select("user_id", "ts", "event_id", c("event_id").alias("section"))
    return triage.as_of(e.select("event_id", "user_id", "ts"), heads, ["user_id"], ["ts", "event_id"], "section").select("event_id", "user_id", "section")


@query("WITH w AS (SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events) SELECT section IS NULL AS before_any, count(*) AS n FROM w GROUP BY 1")
def w03_carried_forward(t):
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    x = ranking.carried(e, F.when(c("event_type") == "signup", c("event_id")), ["ts", "event_id"], ["user_id"], "section")
    return x.select(c("section").isNull().alias("before_any")).groupBy("before_any").agg(F.count(lit(1)).alias("n"))


@query("WITH w AS (SELECT event_type, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id % 12 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events) SELECT event_type, user_id, string_agg(DISTINCT section::VARCHAR, ',' ORDER BY section::VARCHAR) AS sections FROM w WHERE section IS NOT NULL GROUP BY 1, 2")
def a16_sections_of_reference(t):
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    heads = e.where("event_type = 'signup'").select("user_id", "ts", "event_id", (c("event_id") % 12).alias("section"))
    x = triage.as_of(e, heads, ["user_id"], ["ts", "event_id"], "section").where("section is not null")
    return x.groupBy("event_type", "user_id").agg(F.array_join(F.array_sort(F.transform(F.collect_set("section"), lambda v: v.cast("string"))), ",").alias("sections"))


@query(f"WITH {_PAPERS}, m AS (SELECT lower(n_name) AS name, year(l_shipdate) AS y, count(*) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT o_orderkey, lower(n_name) AS name, CASE WHEN o_orderkey % 9 <> 0 THEN year END AS year FROM papers) SELECT o_orderkey, sum(k)::BIGINT AS mentions FROM r JOIN m ON r.name = m.name AND (r.year IS NULL OR abs(m.y - r.year) <= 1) GROUP BY 1")
def j11_name_and_year(t):
    m = t.lineitem.join(t.supplier, c("l_suppkey") == c("s_suppkey")).join(t.nation, c("s_nationkey") == c("n_nationkey"))
    m = m.groupBy(F.lower("n_name").alias("name"), F.year("l_shipdate").alias("year")).agg(F.count(lit(1)).alias("k"))  # equal mentions count together
    r = keyed_orders(t).select("o_orderkey", F.lower("n_name").alias("name"), F.when(c("o_orderkey") % 9 != 0, c("year")).alias("year"))
    return triage.near(r, m, "name", "year").groupBy("o_orderkey").agg(F.sum("k").alias("mentions"))


def titles(t: Tables) -> DataFrame:
    h = c("html")
    return t.pages.select("page_id", F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r"(?s)<h1>(.*?)</h1>", 1).alias("h1"))


_TITLES = "t AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[a-z0-9]+'), lambda x: length(x) > 2)) AS a, list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)), '[a-z0-9]+'), lambda x: length(x) > 2)) AS b FROM pages)"


@query(f"WITH {_TITLES} SELECT page_id, len(a) AS tokens, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END >= 0.6 AS contained FROM t")
def j12_title_containment(t):
    a, b = T.word_tokens(c("title")), T.word_tokens(c("h1"))
    return titles(t).select("page_id", F.size(a).alias("tokens"), (T.containment(a, b) >= 0.6).alias("contained"))


@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text[1:68]), '[a-z0-9]+'), lambda x: length(x) > 2)) AS a FROM documents),
p AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z0-9]+'), lambda x: length(x) > 2)) AS b FROM pages),
r AS (SELECT doc_id, page_id, len(list_intersect(a, b)) AS shared, len(a) AS n FROM d, p) SELECT doc_id, page_id, shared FROM r WHERE shared >= 0.6 * n AND n > 0""")
def j12_titles_in_pages(t):
    """Beginnings of documents as titles: the pages that hold at least 60 % of a title's words."""
    titles = t.documents.select("doc_id", T.word_tokens(F.left("text", lit(68))).alias("words"))
    pages = t.pages.select("page_id", T.word_tokens(F.regexp_replace("html", "<[^>]*>", " ")).alias("words"))
    return matching.contained_titles(titles, pages, "doc_id", "page_id")


def written_drafts(t: Tables) -> DataFrame:
    """A draft for each document: its lines as numbered sections, commas and full stops as places where a year is cited."""
    year = (c("doc_id") % 30 + 1990).cast("string")
    line = lambda x, i: F.concat(lit("\n# "), (i + 1).cast("string"), lit(". "), F.regexp_replace(F.regexp_replace(x, lit(", "), F.concat(lit(" et al. ("), year, lit("a) "))), lit("[.] "), F.concat(lit(" ["), year, lit("]; "))))
    return t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "").alias("draft"))


def cited_names(t: Tables) -> DataFrame:
    """Three references a document: its first word in the year of its draft, the word before its first comma a year later, its last two words in any year."""
    d = c("doc_id")
    name = lambda pattern: F.regexp_extract("text", pattern, 1)
    return t.documents.select(d, F.explode(F.array(
        F.struct(name(r"^\s*(\S+)").alias("name"), (d % 30 + 1990).cast("int").alias("year")),
        F.struct(name(r"^[^,]*?(\S+),").alias("name"), (d % 30 + 1991).cast("int").alias("year")),
        F.struct(name(r"(?<!\S)(\S++ \S++)\W*+$").alias("name"), lit(None).cast("int").alias("year")),
    )).alias("r")).select("doc_id", "r.*")


@query()
def j11_citing_sections(t):
    """Which sections of a document's draft cite its references: whole texts, a name within 45 characters of its year."""
    x = matching.citing_sections(cited_names(t), written_drafts(t), "doc_id", "draft", "name", "year")
    return x.select("doc_id", "name", "year", F.array_join(F.transform("sections", lambda s: s.cast("string")), ",").alias("sections"))


@query(f"WITH {_TITLES} SELECT page_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS ratio FROM t")
def f31_overlap_ratio(t):
    return titles(t).select("page_id", F.round(T.containment(T.word_tokens(c("title")), T.word_tokens(c("h1"))), 6).alias("ratio"))


@query("WITH t AS (SELECT page_id, regexp_extract_all(lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '[a-z]{4,}') AS a, regexp_extract_all(lower(url), '[a-z]{4,}') AS b FROM pages) SELECT page_id, list_has_any(a, b) AS shared FROM t")
def j13_shared_word(t):
    return t.pages.select("page_id", F.arrays_overlap(T.title_tokens(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), T.title_tokens(c("url"))).alias("shared"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' WHEN l.quality = 1 THEN 'record' ELSE 'cut' END AS tier, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS note FROM documents d LEFT JOIN labels l USING (doc_id)")
def j14_sticky_decisions(t):
    rows = t.documents.select("doc_id", text_of("10.1/d", c("doc_id")).alias("doi"), lit("").alias("tier"), lit("").alias("note"))
    prior = t.labels.select(text_of(" 10.1/D", c("doc_id")).alias("doi"), F.when(c("quality") == 1, "record").otherwise("cut").alias("tier"), F.when(c("toxic") == 1, " toxic ").alias("note"))
    return triage.keep_decisions(rows, prior, "doi", ("tier", "note")).select("doc_id", "tier", "note")


@query("SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 3)")
def j15_carried_over(t):
    return triage.carried_over(t.labels.where("quality = 1").select("doc_id"), t.documents.where("lang = 'en'").select("doc_id"), t.embeddings.where("label < 3").select(c("vec_id").alias("doc_id")), "doc_id")


@query("SELECT l.doc_id, l.quality, d.source, d.doc_id IS NULL AS flagged FROM labels l LEFT JOIN (SELECT doc_id, source FROM documents WHERE lang = 'en') d USING (doc_id)")
def j16_concepts_to_nodes(t):
    nodes = t.documents.where("lang = 'en'").select("doc_id", "source", lit(True).alias("_n"))
    return t.labels.join(nodes, "doc_id", "left").select("doc_id", "quality", "source", c("_n").isNull().alias("flagged"))


@query("SELECT o_custkey AS stem, nullif(concat_ws('|', string_agg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey), string_agg(CASE WHEN o_orderstatus = 'P' THEN o_orderkey::VARCHAR END, ',' ORDER BY o_orderkey)), '') AS corpus FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def j18_text_sources(t):
    side = lambda s, name: t.orders.where(c("o_orderstatus") == s).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias(name))
    x = t.customer.select(c("c_custkey").alias("o_custkey")).join(side("F", "f"), "o_custkey", "left").join(side("P", "p"), "o_custkey", "left")
    return x.select(c("o_custkey").alias("stem"), T.known(F.concat_ws("|", "f", "p")).alias("corpus")).where("corpus is not null")


_TREE = "a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents), b AS (SELECT item_id AS path, sha256(text) AS h FROM benchmark)"


@query(f"WITH {_TREE} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'extra' WHEN a.h = b.h THEN 'in-sync' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.path = b.path")
def j19_tree_sync(t):
    return reconcile.tree_sync(t.documents.select(c("doc_id").alias("path"), c("text").alias("content")), t.benchmark.select(c("item_id").alias("path"), c("text").alias("content")))


@query("""WITH a AS (SELECT lang || '/' || source || '/d' || doc_id AS path, sha256(text) AS h FROM documents),
b AS (SELECT lang || '/' || source || '/d' || doc_id AS path, sha256(CASE WHEN source = 'src3' AND n_chars % 2 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE source <> 'src5' OR n_chars % 3 > 0 UNION ALL SELECT 'en/extra/b' || item_id, sha256(text) FROM benchmark)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'extra' WHEN a.h = b.h THEN 'in-sync' ELSE 'updated' END AS state FROM a FULL JOIN b ON a.path = b.path""")
def j19_tree_sync_by_folders(t):
    """Documents as files in folders of language and source, against a copy in which one source was edited, one thinned out and a folder added."""
    d, sha = t.documents, lambda x: F.sha2(x.cast("binary"), 256).alias("digest")
    path = text_of(c("lang"), "/", c("source"), "/d", c("doc_id")).alias("path")
    edited = F.when((c("source") == "src3") & (c("n_chars") % 2 == 0), F.concat("text", lit("."))).otherwise(c("text"))
    copy = d.where("source <> 'src5' or n_chars % 3 > 0").select(path, sha(edited)).unionByName(t.benchmark.select(text_of("en/extra/b", c("item_id")).alias("path"), sha(c("text"))))
    return reconcile.tree_sync_by_folders(d.select(path, sha(c("text"))), copy)


@query(f"WITH {_TREE} SELECT bool_or(b.path IS NULL OR a.path IS NULL OR a.h <> b.h) AS differs FROM a FULL JOIN b ON a.path = b.path")
def a20_any_drift(t):
    return QUERIES["j19_tree_sync"](t.spark, t.folder).agg(F.bool_or(c("state") != "in-sync").alias("differs"))


@query("SELECT count(p_partkey) AS copied, count(*) FILTER (p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25")
def a21_export_totals(t):
    x = t.lineitem.join(t.part.where("p_size < 25").select("p_partkey"), c("l_partkey") == c("p_partkey"), "left")
    return x.agg(F.count("p_partkey").alias("copied"), F.count_if(c("p_partkey").isNull()).alias("missing"))


@query("SELECT l_orderkey, count(*) FILTER (p_partkey IS NULL) AS missing FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25 GROUP BY 1")
def j20_member_files(t):
    x = t.lineitem.join(t.part.where("p_size < 25").select("p_partkey"), c("l_partkey") == c("p_partkey"), "left")
    return x.groupBy("l_orderkey").agg(F.count_if(c("p_partkey").isNull()).alias("missing"))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_discount > 0.05)")
def j21_cache_misses(t):
    return t.lineitem.select("l_partkey").distinct().join(t.lineitem.where("l_linestatus = 'O' and l_discount > 0.05").select("l_partkey"), "l_partkey", "left_anti")


# ---------------------------------------------------------------- citations of a draft


_STATUS = """cit AS (SELECT 'k' || c_custkey AS key, c_name AS surname, floor(c_acctbal)::INT::VARCHAR AS year, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'D' || c_custkey || '. ' END AS doi FROM customer
 UNION ALL SELECT 'k' || s_suppkey, s_name, floor(s_acctbal)::INT::VARCHAR, NULL FROM supplier),
keyed AS (SELECT DISTINCT 'k' || o_custkey AS stem FROM orders WHERE o_orderpriority = '1-URGENT'),
lib AS (SELECT surname, year, list_sort(list(DISTINCT stem)) AS stems FROM (SELECT c_name AS surname, floor(c_acctbal)::INT::VARCHAR AS year, 's' || c_nationkey AS stem FROM customer WHERE c_acctbal < 3000
 UNION ALL SELECT s_name, floor(s_acctbal)::INT::VARCHAR, 's' || s_nationkey FROM supplier UNION ALL SELECT s_name, floor(s_acctbal)::INT::VARCHAR, 'z' FROM supplier WHERE s_acctbal < 2000) GROUP BY 1, 2),
dois AS (SELECT 'd' || o_custkey AS doi, arg_max('s' || o_orderkey, o_orderkey) AS stem FROM orders GROUP BY 1),
res AS (SELECT c.key AS cited, c.surname, c.year, CASE WHEN k.stem IS NOT NULL OR d.stem IS NOT NULL OR len(l.stems) = 1 THEN 'MATCHED' WHEN len(l.stems) > 1 THEN 'AMBIGUOUS' ELSE 'MISSING' END AS status,
 CASE WHEN k.stem IS NOT NULL THEN k.stem WHEN d.stem IS NOT NULL THEN d.stem WHEN len(l.stems) = 1 THEN l.stems[1] END AS stem,
 CASE WHEN k.stem IS NOT NULL THEN 'key' WHEN d.stem IS NOT NULL THEN 'doi' WHEN len(l.stems) >= 1 THEN 'author-year' END AS method
 FROM cit c LEFT JOIN keyed k ON c.key = k.stem LEFT JOIN dois d ON lower(trim(c.doi, '. ')) = d.doi LEFT JOIN lib l ON c.surname = l.surname AND c.year = l.year)"""


def statuses(t: Tables) -> DataFrame:
    """Citations of every customer and supplier against a library of keys (urgent orders), DOIs (all orders; the last of a customer counts) and names."""
    doi = F.when(c("c_mktsegment") == "MACHINERY", text_of("D", c("c_custkey"), ". "))
    cit = t.customer.select(text_of("k", c("c_custkey")).alias("key"), c("c_name").alias("surname"), _whole("c_acctbal"), doi.alias("doi"), lit("").alias("title"))
    cit = cit.unionByName(t.supplier.select(text_of("k", c("s_suppkey")).alias("key"), c("s_name").alias("surname"), _whole("s_acctbal"), lit(None).cast("string").alias("doi"), lit("").alias("title")))
    keyed = t.orders.where("o_orderpriority = '1-URGENT'").select(text_of("k", c("o_custkey")).alias("stem"), lit("").alias("surname"), lit("").alias("year"), lit("").alias("title"))
    stems = t.customer.where("c_acctbal < 3000").select(text_of("s", c("c_nationkey")).alias("stem"), c("c_name").alias("surname"), _whole("c_acctbal"), lit("").alias("title"))
    named = lambda stem, d: d.select(stem.alias("stem"), c("s_name").alias("surname"), _whole("s_acctbal"), lit("").alias("title"))
    stems = stems.unionByName(named(text_of("s", c("s_nationkey")), t.supplier)).unionByName(named(lit("z"), t.supplier.where("s_acctbal < 2000"))).unionByName(keyed)
    dois = t.orders.select(text_of("d", c("o_custkey")).alias("doi"), text_of("s", c("o_orderkey")).alias("stem"), c("o_orderkey").alias("pos"))
    return reconcile.match_citations(cit, stems, dois)


def _whole(money: str) -> Column:
    return F.floor(money).cast("int").cast("string").alias("year")


@query(f"WITH {_PAPERS}, {_STATUS} SELECT * FROM res")
def p09_citation_status(t):
    return statuses(t).select(c("key").alias("cited"), "surname", "year", "status", "stem", "method")


@query(f"WITH {_PAPERS}, {_STATUS} SELECT status, count(*) AS n FROM res GROUP BY 1")
def a04_status_counts(t):
    return statuses(t).groupBy("status").agg(F.count(lit(1)).alias("n"))


def spelled(name: Column) -> Column:
    """A name in letters only."""
    return F.translate(F.lower(name), "0123456789_ ", "abcdefghijxy")


_SPELLED = "translate(lower(n_name), '0123456789_ ', 'abcdefghijxy')"


def drafts(t: Tables) -> DataFrame:
    """A draft per customer: its orders as bracketed author-year tokens, then a reference list."""
    p = keyed_orders(t).withColumn("n_name", F.initcap(spelled(c("n_name"))))
    token = F.when(c("o_orderkey") % 3 == 0, text_of(c("n_name"), " et al. ", c("year"))).otherwise(text_of(c("n_name"), " ", c("year"), "b"))
    ref = text_of(c("n_name"), " A. (", c("year"), "). Title of ", c("o_orderkey"), ". doi 10.1234/x", c("o_orderkey"), ".", F.when(c("o_orderstatus") == "P", "\nUnable to verify").otherwise(""))
    x = p.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", token.alias("t"), ref.alias("r")))), lambda s: F.struct(s["t"].alias("t"), s["r"].alias("r"))).alias("l"))
    body = F.array_join(F.transform("l", lambda s: F.concat(lit("text ["), s["t"], lit("; see 0.1] and [0.1–0.3] more"))), "\n")
    return x.select("o_custkey", F.concat(lit("## References\nold\n\n"), body, lit("\n## References\n\n"), F.array_join(F.transform("l", lambda s: s["r"]), "\n\n")).alias("draft"))


@query(f"WITH {_PAPERS} SELECT o_custkey, {_SPELLED} AS surname, year::VARCHAR AS year, count(*) AS n FROM papers GROUP BY 1, 2, 3")
def s21_intext_citations(t):
    d = drafts(t).select("o_custkey", T.body_and_references(c("draft"))["body"].alias("body"))
    x = reconcile.bracket_tokens(d, c("body")).select("o_custkey", U.surname_key(c("author")).alias("surname"), "year")
    return x.groupBy("o_custkey", "surname", "year").agg(F.count(lit(1)).alias("n"))


@query(f"WITH {_PAPERS} SELECT {_SPELLED} AS surname, year::VARCHAR AS year, count(*) AS n FROM papers GROUP BY 1, 2")
def a10_intext_counts(t):
    return QUERIES["s21_intext_citations"](t.spark, t.folder).groupBy("surname", "year").agg(F.sum("n").alias("n"))


@query(f"WITH {_PAPERS} SELECT o_custkey, o_orderkey::VARCHAR AS id, year::VARCHAR AS year, '10.1234/x' || o_orderkey AS doi, 'Title of ' || o_orderkey AS title, o_orderstatus = 'P' AS unverified FROM papers")
def s20_reference_list(t):
    d = drafts(t).select("o_custkey", T.body_and_references(c("draft"))["refs"].alias("refs"))
    return reconcile.reference_blocks(d.select("o_custkey", "refs"), c("refs")).select("o_custkey", F.regexp_extract("title", r"(\d+)$", 1).alias("id"), "year", "doi", "title", "unverified")


@query("SELECT o_custkey, count(*) + 1 AS body_lines, count(*) AS refs FROM orders GROUP BY 1")
def s22_body_and_references(t):
    s = drafts(t).select("o_custkey", T.body_and_references(c("draft")).alias("s"))
    return s.select("o_custkey", (F.regexp_count("s.body", lit("more")) + 1).cast("bigint").alias("body_lines"), F.regexp_count("s.refs", lit(r"10\.1234/x")).cast("bigint").alias("refs"))


@query("SELECT o_custkey, 'before' AS kept FROM orders GROUP BY 1")
def s23_draft_before_bibliography(t):
    x = drafts(t).select("o_custkey", F.concat(lit("before\n[image1]: data\n"), "draft").alias("d"))
    return x.select("o_custkey", F.trim(F.regexp_replace(T.before_bibliography(c("d")), r"\s+", " ")).alias("kept"))


def tex(t: Tables) -> DataFrame:
    x = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.year("o_orderdate").alias("y")))).alias("l"))
    said = F.array_join(F.transform("l", lambda s: F.concat(lit("\\citep[see][]{k"), (s["o_orderkey"] % 7).cast("string"), lit(", k"), s["o_orderkey"].cast("string"), lit("} \\cite{k"), s["o_orderkey"].cast("string"), lit("}"))), " ")
    items = F.array_join(F.transform("l", lambda s: F.concat(lit("\\bibitem{k"), s["o_orderkey"].cast("string"), lit("} F.M.~Ahr\\'ens, B. Other. \\emph{On {the} "), s["o_orderkey"].cast("string"), lit("}. 1999, "), s["y"].cast("string"), lit(". doi 10.1234/z"), s["o_orderkey"].cast("string"), lit("."))), "\n")
    return x.select("o_custkey", F.concat(said, lit("\n"), items, lit("\n\\end{thebibliography}")).alias("tex"))


@query("WITH k AS (SELECT o_custkey, 'k' || o_orderkey % 7 AS key, 1 AS n FROM orders UNION ALL SELECT o_custkey, 'k' || o_orderkey, 2 FROM orders) SELECT o_custkey, key, sum(n)::BIGINT AS n FROM k GROUP BY 1, 2")
def s18_tex_cites(t):
    return reconcile.tex_cites(tex(t), c("tex")).select("o_custkey", "key", "n")


@query("WITH k AS (SELECT 'k' || o_orderkey % 7 AS key, 1 AS n FROM orders UNION ALL SELECT 'k' || o_orderkey, 2 FROM orders) SELECT key, sum(n)::BIGINT AS n FROM k GROUP BY 1")
def a11_cite_key_counts(t):
    return reconcile.tex_cites(tex(t), c("tex")).groupBy("key").agg(F.sum("n").alias("n"))


@query("SELECT o_custkey, 'k' || o_orderkey AS key, 'Ahrens' AS author, year(o_orderdate)::VARCHAR AS year, '10.1234/z' || o_orderkey AS doi, 'On the' AS title FROM orders")
def s19_tex_items(t):
    return reconcile.tex_bibitems(tex(t), c("tex")).select("o_custkey", "key", "author", "year", "doi", "title")


@query(f"WITH {_PAPERS} SELECT o_custkey, count(*) FILTER (year >= 1995) AS converted, count(*) FILTER (year < 1995) AS flagged FROM papers GROUP BY 1")
def j17_rewrite_citations(t):
    d = drafts(t).select("o_custkey", T.body_and_references(c("draft"))["body"].alias("body"))
    p = keyed_orders(t).where("year >= 1995").select(spelled(c("n_name")).alias("surname"), c("year").cast("string").alias("year")).distinct()
    return reconcile.rewrite_citations(d, "o_custkey", c("body"), p.select("surname", "year", F.concat("surname", "year").alias("stem"))).select("o_custkey", "converted", "flagged")


@query(f"SELECT n_nationkey, {_SPELLED} AS surname, '2019' AS year FROM nation")
def f34_author_year_token(t):
    x = t.nation.select("n_nationkey", T.author_year(text_of(" ", F.initcap(spelled(c("n_name"))), " and Other 2019a ")).alias("a"))
    return x.select("n_nationkey", U.surname_key(c("a.author")).alias("surname"), "a.year")


# ---------------------------------------------------------------- triage

_TIERS = """x AS (SELECT o_orderkey, year(o_orderdate) AS year, list(DISTINCT l_linenumber) FILTER (l_linenumber IS NOT NULL) AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 30 GROUP BY 1, 2),
tiers AS (SELECT o_orderkey, year, CASE WHEN o_orderkey % 10 = 0 THEN 'unknown' WHEN coalesce(len(s), 0) = 0 THEN 'cut' WHEN len(list_filter(s, lambda v: v NOT IN (2, 6))) = 0 THEN 'cut' WHEN year >= 1997 THEN 'current' ELSE 'replace' END AS tier FROM x)"""


def tiers(t: Tables) -> DataFrame:
    s = t.lineitem.where("l_quantity > 30").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("s"))
    x = t.orders.join(s, c("o_orderkey") == c("l_orderkey"), "left")
    y = F.year("o_orderdate")
    return x.select("o_orderkey", y.alias("year"), triage.tier(y, c("s"), F.array(lit(2), lit(6)), c("o_orderkey") % 10 != 0, 1997).alias("tier"), "o_orderstatus", "o_orderpriority")


@query(f"WITH {_TIERS} SELECT o_orderkey, year, tier FROM tiers")
def p08_proposed_tier(t):
    return tiers(t).select("o_orderkey", "year", "tier")


@query(f"WITH {_TIERS} SELECT tier, count(*) AS n, count(*) FILTER (year < 1997) AS before FROM tiers GROUP BY 1")
def a02_tier_counts(t):
    return tiers(t).groupBy("tier").agg(F.count(lit(1)).alias("n"), F.count_if(c("year") < 1997).alias("before"))


_WORK = f"{_TIERS}, w AS (SELECT t.o_orderkey AS id, CASE t.tier WHEN 'unknown' THEN '' ELSE t.tier END AS tier, CASE WHEN t.o_orderkey % 13 = 0 THEN '' ELSE t.year::VARCHAR END AS year, o_orderpriority AS author, o_orderstatus = 'F' AS have FROM tiers t JOIN orders USING (o_orderkey))"


def work(t: Tables) -> DataFrame:
    return tiers(t).select(c("o_orderkey").alias("id"), F.when(c("tier") == "unknown", "").otherwise(c("tier")).alias("tier"), F.when(c("o_orderkey") % 13 == 0, "").otherwise(c("year").cast("string")).alias("year"), c("o_orderpriority").alias("author"), (c("o_orderstatus") == "F").alias("have"))


@query(f"WITH {_WORK} SELECT count(*) FILTER (tier = '') AS undecided, count(*) FILTER (tier NOT IN ('', 'cut')) AS kept, count(*) FILTER (tier NOT IN ('', 'cut') AND have) AS have, count(*) FILTER (tier = 'cut') AS cut FROM w")
def a03_worklist_counts(t):
    kept = (c("tier") != "") & (c("tier") != "cut")
    return work(t).agg(F.count_if(c("tier") == "").alias("undecided"), F.count_if(kept).alias("kept"), F.count_if(kept & c("have")).alias("have"), F.count_if(c("tier") == "cut").alias("cut"))


@query(f"WITH {_WORK} SELECT id, tier FROM w WHERE tier NOT IN ('', 'cut') AND NOT have")
def p21_worklist(t):
    return triage.worklist(work(t)).select("id", "tier")


_NUMBERED = f"WITH {_WORK} SELECT id, tier, CASE tier WHEN 'replace' THEN 2 WHEN 'current' THEN 3 ELSE 9 END AS tier_rank, row_number() OVER (PARTITION BY tier ORDER BY coalesce(nullif(year, ''), '0'), author, id) AS number FROM w WHERE tier NOT IN ('', 'cut') AND NOT have"


@query(_NUMBERED)
def w05_number_in_tier(t):
    return triage.worklist(work(t)).select("id", "tier", "tier_rank", "number")


@query(f"SELECT id, row_number() OVER (ORDER BY tier_rank, number) AS place FROM ({_NUMBERED})")
def o05_worklist_order(t):
    """The whole worklist in the order it is written."""
    return ranking.places(triage.worklist(work(t)), ["tier_rank", *triage.worklist_order()]).select("id", "place")


@query(f"WITH {_WORK} SELECT id, row_number() OVER (ORDER BY CASE WHEN tier = '' THEN 0 ELSE 1 END, coalesce(try_cast(year AS INT), 0), author, id) AS place FROM w")
def o04_triage_order(t):
    """The whole triage table in the order it is written: undecided first, then by year and author."""
    order = [F.when(c("tier") == "", 0).otherwise(1), F.coalesce(F.expr("try_cast(year as int)"), lit(0)), "author", "id"]
    return ranking.places(work(t), order).select("id", "place")


# ---------------------------------------------------------------- candidates, phrases, concepts, categories

_HITS = """h AS (SELECT l_partkey AS doi, 'A' AS mode, l_orderkey AS seed, CASE WHEN l_linenumber % 2 = 0 THEN 'out' ELSE 'in' END AS direction FROM lineitem WHERE l_quantity > 40
 UNION ALL SELECT p_partkey, 'B', NULL, NULL FROM part WHERE p_type LIKE '%STEEL%' OR p_size < 10),
cand AS (SELECT doi, string_agg(DISTINCT mode, '+' ORDER BY mode) AS mode, count(DISTINCT seed) AS seeds, count(DISTINCT seed) FILTER (direction = 'out') AS n_out, count(DISTINCT seed) FILTER (direction = 'in') AS n_in FROM h GROUP BY 1)"""


def hits(t: Tables) -> DataFrame:
    nil = lambda kind: lit(None).cast(kind)
    a = t.lineitem.where("l_quantity > 40").select(c("l_partkey").alias("doi"), lit("A").alias("mode"), c("l_orderkey").alias("seed"), F.when(c("l_linenumber") % 2 == 0, "out").otherwise("in").alias("direction"), nil("string").alias("query"), c("l_orderkey").alias("pos"), c("l_partkey").alias("cites"))
    b = t.part.where("p_type like '%STEEL%' or p_size < 10").select(c("p_partkey").alias("doi"), lit("B").alias("mode"), nil("bigint").alias("seed"), nil("string").alias("direction"), c("p_brand").alias("query"), (c("p_partkey") + 10**9).alias("pos"), c("p_partkey").alias("cites"))
    return a.unionByName(b).withColumns({k: lit("") for k in ("title", "author", "year", "venue")})


@query(f"WITH {_HITS} SELECT doi, mode, seeds FROM cand")
def u01_candidate_union(t):
    return discover.merge_candidates(hits(t)).select("doi", F.array_join("modes", "+").alias("mode"), c("seeds").cast("bigint").alias("seeds"))


@query(f"WITH {_HITS} SELECT doi, mode FROM cand")
def f30_mode_label(t):
    return discover.merge_candidates(hits(t)).select("doi", F.array_join(F.array_sort("modes"), "+").alias("mode"))


@query(f"""WITH {_HITS} SELECT doi, concat_ws('; ', CASE WHEN n_out > 0 THEN 'cited by ' || n_out || ' of my papers' END, CASE WHEN n_in > 0 THEN 'cites ' || n_in || ' of my papers' END, CASE WHEN contains(mode, 'B') THEN 'matched query "' || p_brand || '"' END) AS why FROM cand JOIN part ON doi = p_partkey""")
def a08_candidate_reason(t):
    return discover.merge_candidates(hits(t)).select("doi", discover.why().alias("why"))


@query(f"WITH {_HITS} SELECT doi, row_number() OVER (ORDER BY contains(mode, 'A') DESC, seeds DESC, doi DESC) AS place FROM cand ORDER BY place LIMIT 40")
def o02_candidate_ranking(t):
    """The 40 best candidates: a top-k report."""
    top = discover.ranked(discover.merge_candidates(hits(t)), 40)
    return top.select("doi", F.row_number().over(Window.orderBy(F.array_contains("modes", "A").desc(), F.desc("seeds"), F.desc("cites"), "doi")).alias("place"))


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOP_WORDS))
_BIGRAMS = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z][a-z\\-]+'), 1) AS i FROM documents),
pair AS (SELECT a.doc_id, a.w || ' ' || b.w AS phrase, a.i FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE length(a.w) > 2 AND length(b.w) > 2 AND a.w NOT IN ({_STOPS}) AND b.w NOT IN ({_STOPS})),
phr AS (SELECT doc_id, phrase, count(*) AS n, min(i)::INT AS first FROM pair GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query(f"WITH {_BIGRAMS} SELECT * FROM phr")
def a14_phrases(t):
    return discover.phrases(t.documents, "doc_id", c("text"))


@query(f"WITH {_BIGRAMS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM phr) SELECT * FROM r WHERE rank <= 8")
def o06_common_phrases(t):
    return discover.top_phrases(t.documents, "doc_id", c("text"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z][a-z\\-]+'))::INT AS n FROM documents")
def f10_phrase_tokens(t):
    return t.documents.select("doc_id", F.size(T.phrase_tokens(c("text"))).alias("n"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')))::INT AS n FROM documents")
def f08_title_tokens(t):
    return t.documents.select("doc_id", F.size(T.title_tokens(c("text"))).alias("n"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2)))::INT AS n FROM documents")
def f09_word_tokens(t):
    return t.documents.select("doc_id", F.size(T.word_tokens(c("text"))).alias("n"))


@query("SELECT lower(p_type) AS concept, count(*) AS n, count(DISTINCT p_brand) AS papers FROM part GROUP BY 1")
def a09_concepts(t):
    k = t.part.select(c("p_brand").alias("stem"), F.when(c("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(text_of(" ", F.lower("p_type"))).alias("keyword"), c("p_partkey").alias("pos"))
    return discover.concepts(k).select(F.lower("concept").alias("concept"), "n", F.size("papers").cast("bigint").alias("papers"))


@query("WITH k AS (SELECT lower(p_type) AS concept, count(*) AS n FROM part GROUP BY 1) SELECT concept, row_number() OVER (ORDER BY n DESC, concept) AS place FROM k")
def o03_concept_order(t):
    k = discover.concepts(t.part.select(c("p_brand").alias("stem"), c("p_type").alias("keyword"), c("p_partkey").alias("pos")))
    return ranking.places(k.select(F.lower("concept").alias("concept"), "n"), [("n", True), "concept"]).select("concept", "place")


# Short function words stand in for the built-in categories, which these texts do not mention.
_LABELS = {"Human": "the|and", "Rodent": "der|die|und", "In Vitro": "de|la|en"}
_LABEL_SQL = "tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents), hc AS (SELECT doc_id, count(*) FILTER (w IN ('the', 'and')) AS h, count(*) FILTER (w IN ('der', 'die', 'und')) AS r, count(*) FILTER (w IN ('de', 'la', 'en')) AS v FROM tk GROUP BY 1), lb AS (SELECT d.doc_id, lang, CASE WHEN greatest(coalesce(h, 0), coalesce(r, 0), coalesce(v, 0)) = 0 THEN 'Unknown' WHEN h >= r AND h >= v THEN 'Human' WHEN r >= v THEN 'Rodent' ELSE 'In Vitro' END AS label FROM documents d LEFT JOIN hc USING (doc_id))"


@query(f"WITH {_LABEL_SQL} SELECT doc_id, label FROM lb")
def a12_argmax_category(t):
    return t.documents.select("doc_id", discover.classified(F.lower("text"), _LABELS).alias("label"))


@query(f"WITH {_LABEL_SQL}, g AS (SELECT * FROM (VALUES ('Human'), ('Rodent'), ('In Vitro')) a(label), (VALUES ('en'), ('de'), ('fr'), ('xx')) b(lang)), n AS (SELECT g.label, g.lang, count(lb.doc_id) AS n FROM g LEFT JOIN lb ON g.label = lb.label AND g.lang = lb.lang GROUP BY 1, 2) SELECT label, lang, n, round(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN 100.0 * n / sum(n) OVER (PARTITION BY label) ELSE 0 END, 6) AS percent FROM n")
def a13_crosstab(t):
    x = t.documents.select("lang", discover.classified(F.lower("text"), _LABELS).alias("label"))
    return discover.crosstab(x, "label", "lang", ["Human", "Rodent", "In Vitro"], ["en", "de", "fr", "xx"]).withColumn("percent", F.round("percent", 6))


@query("SELECT source, lang, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) AS percent FROM documents GROUP BY 1, 2")
def w06_percent_of_group(t):
    n = t.documents.groupBy("source", "lang").agg(F.count(lit(1)).alias("n"))
    return n.select("source", "lang", F.round(100 * c("n") / F.sum("n").over(Window.partitionBy("source")), 6).alias("percent"))


@query("SELECT source, count(*) AS n, count(*) FILTER (quality IS NOT NULL) AS populated FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a01_source_counts(t):
    return t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count(lit(1)).alias("n"), F.count_if(c("quality").isNotNull()).alias("populated"))


# ---------------------------------------------------------------- sets

_S = "a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48)"


def two_sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = lambda w: t.lineitem.where(w).select(c("l_partkey").alias("k"))
    return s("l_returnflag = 'R'"), s("l_quantity > 48")


@query(f"WITH {_S} SELECT k FROM a UNION SELECT k FROM b")
def u02_key_union(t):
    a, b = two_sets(t)
    return a.union(b).distinct()


@query(f"WITH {_S} SELECT k FROM a EXCEPT SELECT k FROM b")
def u03_difference(t):
    a, b = two_sets(t)
    return a.subtract(b)


@query(f"WITH {_S} SELECT k FROM a INTERSECT SELECT k FROM b")
def u04_intersection(t):
    a, b = two_sets(t)
    return a.intersect(b)


_ARR = "s AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS a, list(DISTINCT l_linenumber) FILTER (l_quantity > 25) AS b FROM lineitem GROUP BY 1)"


def arrays(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("a"), F.collect_set(F.when(c("l_quantity") > 25, c("l_linenumber"))).alias("b"))


@query(f"WITH {_ARR} SELECT l_orderkey, len(list_filter(a, lambda v: v NOT IN (1, 2, 3))) = 0 AS subset FROM s")
def u05_subset(t):
    return arrays(t).select("l_orderkey", (F.size(F.array_except("a", F.array(lit(1), lit(2), lit(3)))) == 0).alias("subset"))


@query(f"WITH {_ARR} SELECT l_orderkey, len(a) = coalesce(len(b), 0) AS equal FROM s")
def u06_equality(t):
    return arrays(t).select("l_orderkey", ((F.size(F.array_except("a", "b")) == 0) & (F.size(F.array_except("b", "a")) == 0)).alias("equal"))


@query(f"WITH {_ARR} SELECT l_orderkey, len(list_distinct(list_concat(coalesce(b, []), [1, 9])))::INT AS n FROM s")
def u07_union_size(t):
    return arrays(t).select("l_orderkey", F.size(F.array_union("b", F.array(lit(1), lit(9)))).alias("n"))


# ---------------------------------------------------------------- scalar functions on built texts


@query("SELECT p_partkey, '10.1000/part' || p_partkey AS doi FROM part")
def f01_doi_without_resolver(t):
    return t.part.select("p_partkey", T.doi_without_resolver(text_of(" HTTPS://dx.doi.org/10.1000/Part", c("p_partkey"), " ")).alias("doi"))


@query("SELECT p_partkey, '10.1000/part' || p_partkey AS doi FROM part")
def f02_doi_without_dots(t):
    return t.part.select("p_partkey", T.doi_without_dots(text_of(" 10.1000/Part", c("p_partkey"), ".. ")).alias("doi"))


@query("SELECT p_partkey, '10.1000/part' || p_partkey AS doi FROM part")
def f03_first_doi(t):
    return t.part.select("p_partkey", T.first_doi(text_of("see doi:10.1000/part", c("p_partkey"), "). Next 10.2000/x")).alias("doi"))


@query("SELECT p_partkey, '10.1000/part' || p_partkey AS in_brackets, '10.1000/part' || p_partkey || ']x' AS in_cell FROM part")
def f04_doi_variants(t):
    x = text_of("[10.1000/part", c("p_partkey"), "]x y")
    return t.part.select("p_partkey", T.first_doi_in_brackets(x).alias("in_brackets"), T.first_doi_in_cell(x).alias("in_cell"))


@query()
def f05_without_diacritics(t):
    """Every document; other libraries strip other characters, so tests hold it against the Unicode database instead of SQL."""
    return t.documents.select("doc_id", U.without_diacritics("text").alias("plain"))


@query("SELECT n_nationkey, lower(regexp_extract(n_name, '[A-Za-z]+', 0)) AS surname FROM nation")
def f06_surname_key(t):
    return t.nation.select("n_nationkey", U.surname_key(text_of("  ", c("n_name"), ", É. and others")).alias("surname"))


@query("SELECT doc_id, lower(strip_accents(text)) AS folded, length(text) AS n FROM documents")
def f07_length_preserving_fold(t):
    x = U.folded("text")
    return t.documents.select("doc_id", x.alias("folded"), F.length(x).cast("bigint").alias("n"))


@query("SELECT o_custkey, string_agg('Order ' || o_orderkey || '.', ' ' ORDER BY o_orderkey) AS s FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1")
def f11_first_sentences(t):
    x = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(lit("Order "), k.cast("string"), lit("."))), "  ").alias("s"))
    return x.select("o_custkey", T.first_sentences(c("s")).alias("s"))


@query("SELECT doc_id, CASE WHEN length(rtrim(text, '. ')) <= 70 THEN rtrim(text, '. ') ELSE regexp_replace(rtrim(text, '. ')[1:70], ' [^ ]*$', '') || '…' END AS title FROM documents")
def f12_short_title(t):
    return t.documents.select("doc_id", T.short_title(c("text")).alias("title"))


@query("SELECT doc_id, text[1:68] || CASE WHEN length(text) > 68 THEN '…' ELSE '' END AS title FROM documents")
def f13_hard_cut(t):
    return t.documents.select("doc_id", T.hard_cut(c("text"), 68).alias("title"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Stobart' END AS label FROM nation")
def f14_author_label(t):
    return t.nation.select("n_nationkey", T.author_label(F.when(c("n_nationkey") % 2 == 0, c("n_name")).otherwise(""), text_of("stobart20", c("n_nationkey"))).alias("label"))


@query("SELECT c_custkey, 'Name' || c_custkey AS word FROM customer")
def f15_last_word(t):
    return t.customer.select("c_custkey", T.last_word(text_of(" A. van der  Name", c("c_custkey"), " ")).alias("word"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\t\\n\\v\\f\\r ]+', ' ', 'g')) AS text FROM documents")
def f16_squeeze(t):
    return t.documents.select("doc_id", T.squeeze(c("text")).alias("text"))


@query("SELECT doc_id, trim(replace(regexp_replace(text, '[\\t\\n\\v\\f\\r ]+', ' ', 'g'), '|', '\\|')) AS cell FROM documents")
def f17_table_cell(t):
    return t.documents.select("doc_id", T.table_cell(c("text")).alias("cell"))


@query("SELECT doc_id, text FROM documents")
def f18_quote_round_trip(t):
    return t.documents.select("doc_id", T.unquoted(T.quoted(c("text"))).alias("text"))


@query("SELECT n_nationkey, 'Ecole ' || n_name || ' end' AS text FROM nation")
def f19_without_tex(t):
    return t.nation.select("n_nationkey", T.without_tex(text_of("\\'{E}cole \\emph{", c("n_name"), "}~\\textbf{{end}}")).alias("text"))


@query("SELECT n_nationkey, lower(regexp_extract(n_name, '[A-Za-z]+', 0)) AS surname FROM nation")
def f20_tex_first_author(t):
    return t.nation.select("n_nationkey", U.surname_key(T.tex_first_author(text_of("M.B.~", c("n_name"), ", X. Other"))).alias("surname"))


@query("SELECT p_partkey, '@article{key' || p_partkey || ', title={A, B}, year={2000}}' AS entry FROM part")
def f21_rekey(t):
    return t.part.select("p_partkey", T.with_key(text_of("@article{Old_2000, title={A, B}, year={2000}}"), text_of("key", c("p_partkey"))).alias("entry"))


@query("SELECT p_partkey, '@misc{' || p_brand || ', title={' || p_name || '}, journal={' || p_type || ' Server}, note={Preprint} }' AS entry FROM part")
def f22_add_venue(t):
    entry = text_of("@misc{", c("p_brand"), ", title={", c("p_name"), "}, \n}  ")
    return t.part.select("p_partkey", T.with_venue(entry, text_of(c("p_type"), " Server")).alias("entry"))


@query("SELECT p_partkey, '@a{k, title={ $\\beta$ -cell \\& H$^\\circ$ ' || p_partkey || '--9 }, year={1}}' AS entry FROM part")
def f23_typesettable(t):
    return t.part.select("p_partkey", T.typesettable(text_of("@a{k, title={<i>β</i>-cell &amp;  H° ", c("p_partkey"), "–9<x>}, url={http://a_b}, DOI={10.1/a_b}, year={1}}")).alias("entry"))


@query("SELECT p_partkey, '{' || p_type || '} waves of ' || p_name || ' in {' || p_type || '2+} and {Rett} model {Ca} 2' || p_partkey AS title FROM part")
def f24_protect_capitals(t):
    return t.part.select("p_partkey", T.protect_capitals(text_of(c("p_type"), " waves of ", c("p_name"), " in ", c("p_type"), "2+ and Rett model Ca 2", c("p_partkey"))).alias("title"))


@query("SELECT p_partkey, '@article{k' || p_partkey || ',\n  title = {' || p_name || '},\n  author = {},\n  year = {' || p_size || '},\n  journal = {},\n}' AS entry FROM part")
def f25_plain_entry(t):
    return t.part.select("p_partkey", T.plain_entry(text_of("k", c("p_partkey")), text_of(" ", c("p_name"), " "), lit(None).cast("string"), c("p_size").cast("string"), lit("")).alias("entry"))


def notes(t: Tables) -> DataFrame:
    """A note per customer with its orders as cited works."""
    x = t.customer.join(t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(lit('"10.1/O'), k.cast("string"), lit('"'))).alias("l")), c("c_custkey") == c("o_custkey"), "left")
    front = T.render_frontmatter(citekey=("plain", text_of("c", c("c_custkey"))), doi=("quoted", text_of('10.1/C"', c("c_custkey"))), source=("plain", lit("jats")), projects=("list", F.array(c("c_mktsegment"))), cited_dois=("list", c("l")))
    return x.select("c_custkey", F.concat(front, lit("\n# Title\n\nsummary\n\n## Concepts\n- [[old]]\n\n## Related\nnone\n")).alias("value"))


@query("SELECT c_custkey, 'c' || c_custkey AS stem, '10.1/c\"' || c_custkey AS doi, c_mktsegment AS projects, coalesce(string_agg('10.1/o' || o_orderkey, ',' ORDER BY o_orderkey), '') AS cited FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4")
def s10_node_scan(t):
    x = notes(t)
    got = files.parse_nodes(x, lit("none"))
    return got.select(F.substr("stem", lit(2)).cast("bigint").alias("c_custkey"), "stem", "doi", F.array_join("projects", ",").alias("projects"), F.array_join("cited", ",").alias("cited"))


@query("SELECT c_custkey, true AS same, 4 AS fences FROM customer")
def s09_frontmatter_split(t):
    v = c("value")
    return notes(t).select("c_custkey", (F.concat(T.frontmatter(v), T.after_frontmatter(v)) == v).alias("same"), (F.regexp_count(T.frontmatter(v), lit("(?m)^---$")) * 2).alias("fences"))


@query("SELECT c_custkey, '---\ncitekey: c' || c_custkey || '\nprojects:\n  - ' || c_mktsegment || '\nempty: []\n---' AS front FROM customer")
def f26_render_frontmatter(t):
    return t.customer.select("c_custkey", T.render_frontmatter(citekey=("plain", text_of("c", c("c_custkey"))), projects=("list", F.array(c("c_mktsegment"))), empty=("list", F.array().cast("array<string>"))).alias("front"))


@query("SELECT c_custkey, '- [[' || c_mktsegment || ']]' AS concepts, true AS again FROM customer")
def f27_section_replace(t):
    body = F.concat(lit("- [["), "c_mktsegment", lit("]]"))
    x = notes(t).join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    once = T.replace_between(c("value"), "## Concepts", "## Related", body)
    return x.select("c_custkey", F.regexp_extract(once, r"## Concepts\n(.*)\n\n## Related\nnone", 1).alias("concepts"), (T.replace_between(once, "## Concepts", "## Related", body) == once).alias("again"))


@query("SELECT c_custkey, 'crossref' AS refs_source, 'jats' AS source FROM customer")
def f28_field_upsert(t):
    front = T.set_front_value(T.frontmatter(c("value")), "refs_source", lit("crossref"), "source")
    return notes(t).select("c_custkey", T.front_value(front, "refs_source").alias("refs_source"), T.front_value(front, "source").alias("source"))


@query(f"WITH {_PAPERS}, lib AS (SELECT DISTINCT {_SPELLED} AS surname, year FROM papers WHERE o_orderpriority = '1-URGENT'), x AS (SELECT p.*, l.surname IS NOT NULL AS known, {_SPELLED} AS s FROM papers p LEFT JOIN lib l ON l.surname = {_SPELLED} AND l.year = p.year) SELECT o_custkey, string_agg(CASE WHEN known THEN '[@' || s || year || '; see 0.1]' ELSE '[' || upper(s[1]) || s[2:] || CASE WHEN o_orderkey % 3 = 0 THEN ' et al. ' || year ELSE ' ' || year || 'b' END || ' ⚠; see 0.1]' END, ' ' ORDER BY o_orderkey) AS groups FROM x GROUP BY 1")
def f29_group_rewrite(t):
    """The rewritten groups of every draft, against a library of the names and years of urgent orders."""
    d = drafts(t).select("o_custkey", T.body_and_references(c("draft"))["body"].alias("body"))
    lib = keyed_orders(t).where("o_orderpriority = '1-URGENT'").select(spelled(c("n_name")).alias("surname"), c("year").cast("string").alias("year")).distinct()
    out = reconcile.rewrite_citations(d, "o_custkey", c("body"), lib.select("surname", "year", F.concat("surname", "year").alias("stem")))
    return out.select("o_custkey", F.array_join(F.regexp_extract_all("body", lit(r"\[[^\]]*; see 0[.]1\]"), lit(0)), " ").alias("groups"))


@query("SELECT o_custkey, 'Work on orders of ' || o_custkey AS query, 1 AS rank FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 'calcium wave', 2 FROM orders GROUP BY 1 HAVING count(*) >= 2")
def f32_search_queries(t):
    x = t.orders.groupBy("o_custkey").agg(F.concat(lit("# Work  on orders of "), c("o_custkey").cast("string"), lit("\n"), F.array_join(F.transform(F.collect_list("o_orderkey"), lambda k: lit("Calcium wave in a model.")), " "), lit("\n## References\nnoise noise noise noise")).alias("plan"))
    return discover.search_queries(x, "o_custkey", c("plan"))


@query("SELECT c_custkey, '\n# Name ' || c_custkey || ' — Title\n\nOne. Two.\n' AS body FROM customer")
def f33_note_body(t):
    return t.customer.select("c_custkey", F.concat(lit("\n# "), T.author_label(lit("Name"), lit("k")), lit(" "), c("c_custkey").cast("string"), lit(" — "), T.short_title(lit("Title. ")), lit("\n\n"), T.first_sentences(lit("One.  Two.")), lit("\n")).alias("body"))


# ---------------------------------------------------------------- scans over built texts and landed payloads


@query("SELECT 'd' || c_custkey AS id, 's' || c_custkey AS stem FROM customer")
def s01_manifest_identifiers(t):
    raw = t.customer.select(F.concat(lit('{"by_id":{"d'), c("c_custkey").cast("string"), lit('":"s'), c("c_custkey").cast("string"), lit('"},"entries":{}}')).alias("value"))
    return files.manifest_tables(raw)[0]


@query("SELECT 's' || c_custkey AS stem, c_name AS title, c_mktsegment AS project FROM customer")
def s02_manifest_entries(t):
    raw = t.customer.select(F.concat(lit('{"entries":{"s'), c("c_custkey").cast("string"), lit('":{"title":"'), "c_name", lit('","projects":["'), "c_mktsegment", lit('"],"other":1}}}')).alias("value"))
    return files.manifest_tables(raw)[1].select("stem", "title", F.get("projects", lit(0)).alias("project"))


@query("SELECT 'd' || c_custkey AS id, 's' || c_custkey AS stem, c_name AS title, 'p' || c_nationkey AS project FROM customer")
def s03_manifest_round_trip(t):
    """A ledger of all customers, written sorted as files in order and read back line by line."""
    path = files.scratch(t.spark) + "/manifest"
    stem = text_of("s", c("c_custkey"))
    papers = t.customer.select(stem.alias("stem"), c("c_name").alias("title"), F.array(text_of("p", c("c_nationkey"))).alias("projects"))
    files.write_manifest(t.customer.select(text_of("d", c("c_custkey")).alias("id"), stem.alias("stem")), papers, path)
    ids, read = files.read_manifest(t.spark, path)
    return ids.join(read, "stem").select("id", "stem", "title", F.get("projects", lit(0)).alias("project"))


@query("""WITH k AS (SELECT DISTINCT 'd' || c_custkey AS id FROM customer), n AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM k),
e AS (SELECT DISTINCT 's' || c_custkey AS id FROM customer), m AS (SELECT id, row_number() OVER (ORDER BY id) AS i FROM e), c AS (SELECT count(*) AS c FROM k)
SELECT id, i + 1 AS line FROM n UNION ALL SELECT id, i + 2 + c FROM m, c""")
def s03_manifest_order(t):
    """On which line of the written ledger each key stands."""
    path = files.scratch(t.spark) + "/manifest"
    stem = text_of("s", c("c_custkey"))
    files.write_manifest(t.customer.select(text_of("d", c("c_custkey")).alias("id"), stem.alias("stem")), t.customer.select(stem.alias("stem"), c("c_name").alias("title")), path)
    lines = files.in_written_order(t.spark, path)
    return lines.select(F.regexp_extract("value", r'^,?"(.*?)":', 1).alias("id"), "line").where("id <> '' and id <> 'by_id'")


@query("SELECT DISTINCT 'tok' || page_id AS token FROM pages WHERE page_id % 3 = 2")
def s04_identifier_lines(t):
    i = c("page_id")
    return files.identifier_lines(t.pages.select(F.when(i % 3 == 0, text_of("  # c", i)).when(i % 3 == 1, "   ").otherwise(text_of("  tok", i, " ")).alias("value")))


@query("SELECT 'doi' || k AS doi, min(page_id) AS pos FROM (SELECT page_id, page_id % 20 AS k FROM pages WHERE page_id % 3 <> 0) GROUP BY 1")
def s05_doi_lines(t):
    i = c("page_id")
    x = files.doi_lines(t.pages.select(F.when(i % 3 == 0, text_of("# c", i)).when(i % 2 == 0, text_of("DOI", i % 20)).otherwise(text_of(" doi", i % 20)).alias("value"), i.alias("pos")))
    return x.select(F.lower("doi").alias("doi"), "pos")


@query("SELECT o_custkey, 'Ca2+ wave ' || o_custkey AS title, 'Name' AS surname, 'plain' AS abstract, string_agg('10.1/o' || o_orderkey, ',' ORDER BY o_orderkey) AS cited FROM orders GROUP BY 1")
def s06_article_scan(t):
    refs = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(lit('<ref><pub-id pub-id-type="doi">10.1/o'), k.cast("string"), lit('</pub-id><pub-id pub-id-type="doi"> 10.1/O'), k.cast("string"), lit('</pub-id><pub-id pub-id-type="pmid">1</pub-id></ref>'))), "").alias("r"))
    head = lit('<article><front><related><article-title>Another</article-title></related><article-meta><article-title>Ca<sup>2+</sup> wave\n ')
    people = lit('</article-title><contrib-group><contrib contrib-type="editor"><surname>Editor</surname></contrib><contrib><surname>Name</surname></contrib><contrib contrib-type="author"><surname>Other</surname></contrib></contrib-group>')
    abstracts = lit('<abstract abstract-type="toc"><p>typed</p></abstract><abstract><p>plain</p></abstract></article-meta></front><back><ref-list>')
    xml = F.concat(head, c("o_custkey").cast("string"), people, abstracts, "r", lit("</ref-list></back></article>"))
    return refs.select("o_custkey", U.article_xml(xml.cast("binary")).alias("a")).select("o_custkey", "a.title", "a.surname", "a.abstract", F.array_join("a.cited", ",").alias("cited"))


@query("SELECT o_custkey, count(*)::INT AS n FROM orders GROUP BY 1")
def s08_article_references(t):
    refs = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.collect_list("o_orderkey"), lambda k: F.concat(lit('<ref><pub-id pub-id-type="doi">10.1/o'), k.cast("string"), lit("</pub-id></ref>"))), "").alias("r"))
    return refs.select("o_custkey", F.size(U.article_xml(F.concat(lit("<article><ref-list>"), "r", lit("</ref-list></article>")).cast("binary"))["cited"]).alias("n"))


@query("SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE string_agg('10.1/o' || o_orderkey, ',' ORDER BY o_orderkey) END AS cited FROM orders GROUP BY 1")
def s07_tei_references(t):
    refs = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.concat(lit('<biblStruct><idno type="DOI">10.1/o'), k.cast("string"), lit("</idno></biblStruct>"))), "").alias("r"))
    xml = F.concat(lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><listBibl>'), "r", F.when(c("o_custkey") % 4 == 0, "").otherwise("</listBibl></TEI>"))
    return refs.select("o_custkey", F.array_join(U.tei_dois(xml.cast("binary")), ",").alias("cited"))


@query("SELECT '10.1234/p' || page_id AS doi, page_id % 2 = 0 AS approved FROM pages WHERE page_id % 5 <> 0")
def s15_markdown_table(t):
    i = c("page_id")
    row = F.when(i % 5 == 0, "|---|---|---|---|---|---|---|---|---|").otherwise(text_of("| ", F.when(i % 2 == 0, "[X]").otherwise("[ ]"), " | 2000 | A | T | V | 3 | https://doi.org/10.1234/P", i, ") | why | A |"))
    head = t.pages.select(lit("| ✓ | year | first author | title | venue | cites | DOI | why | seed |").alias("value"))
    return files.markdown_rows(t.pages.select(row.alias("value")).unionByName(head)).select("doi", "approved")


@query("SELECT DISTINCT 'key' || p_partkey % 100 AS key FROM part")
def s16_bib_keys(t):
    x = t.part.select(text_of("@article{key", c("p_partkey") % 100, ",").alias("value"))
    return files.bib_keys(x.unionByName(x.select(lit("  title = {a, b},").alias("value"))))


@query("SELECT 'c ' || o_custkey AS concept, count(*) AS n, min(o_orderkey)::VARCHAR AS first FROM orders GROUP BY 1")
def s17_concept_lines(t):
    x = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), " , ").alias("l")).select(F.concat(lit("- [[c "), c("o_custkey").cast("string"), lit("]]  <- "), "l", lit(" ")).alias("value"))
    return files.concept_lines(x).groupBy("concept").agg(F.count(lit(1)).alias("n"), F.min_by("stem", "pos").alias("first"))


@query("SELECT doc_id, doc_id % 2 = 0 AS is_pdf FROM documents")
def s25_pdf_predicate(t):
    return t.documents.select("doc_id", T.looks_pdf(F.concat(F.when(c("doc_id") % 2 == 0, "%PDF-1.7").otherwise("%PDX"), F.coalesce("text", lit(""))).cast("binary")).alias("is_pdf"))


@query("SELECT kind, count(*) AS n FROM (SELECT CASE label % 3 WHEN 0 THEN 'fetched' WHEN 1 THEN 're-linked' ELSE 'gap' END AS kind FROM embeddings) GROUP BY 1")
def s30_log_collectors(t):
    part = lambda k: t.embeddings.where(c("label") % 3 == k).select(c("vec_id").cast("string").alias("stem"), lit("").alias("detail"))
    return files.log_rows(part(0), part(1), part(2), "p").groupBy("kind").agg(F.count(lit(1)).alias("n"))


@query("SELECT event_id::VARCHAR AS id, 'S' || event_id AS source, event_type AS authors, event_id % 2 = 0 AS is_oa, false AS broken FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 50 = 0")
def s34_first_hit(t):
    """First hits of search answers that were landed as pages; every fiftieth answer is broken off."""
    i = c("event_id").cast("string")
    answer = F.concat(lit('{"resultList":{"result":[{"source":"S'), i, lit('","authorString":"'), "event_type", lit('","isOpenAccess":"'), F.when(c("event_id") % 2 == 0, "Y").otherwise("N"), F.when(c("event_id") % 50 == 0, "").otherwise('"},{"source":"second"}]}}'))
    path = files.scratch(t.spark) + "/hits"
    pages.land(t.events, F.expr("event_id div 5000"), c("event_id"), answer, path)
    got = pages.read(t.spark, path)
    return got.select("id", landed.first_hit(c("payload")).alias("h"), c("error").isNotNull().alias("broken")).select("id", "h.source", "h.authors", "h.is_oa", "broken")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://pdf/' || page_id WHEN page_id % 3 = 1 THEN 'http://page/' || page_id END AS url FROM pages")
def s37_open_access_url(t):
    i = c("page_id").cast("string")
    payload = F.when(c("page_id") % 3 == 0, F.concat(lit('{"best_oa_location":{"url_for_pdf":"http://pdf/'), i, lit('","url":"http://page/"}}'))).when(c("page_id") % 3 == 1, F.concat(lit('{"best_oa_location":{"url_for_pdf":null,"url":"http://page/'), i, lit('"}}'))).otherwise('{"best_oa_location":null}')
    return t.pages.select("page_id", landed.open_access_url(payload).alias("url"))


@query("SELECT event_id, user_id::INT AS year, event_type AS first_author, event_id AS crossref_citations, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s40_registry_metadata(t):
    """Registry answers that were landed as pages, and a number from the properties that each answer carries as a text."""
    props = F.coalesce(F.regexp_extract(F.to_json(F.array("props")), r"(?s)^\[(.*)\]$", 1), lit("null"))
    answer = F.concat(lit('{"message":{"issued":{"date-parts":[['), c("user_id").cast("string"), lit(']]},"author":[{"family":"'), "event_type", lit('"}],"is-referenced-by-count":'), c("event_id").cast("string"), lit(',"props":'), props, lit("}}"))
    path = files.scratch(t.spark) + "/registry"
    pages.land(t.events, F.expr("event_id div 5000"), c("event_id"), answer, path)
    got = pages.read(t.spark, path)
    k = F.get_json_object(F.get_json_object("payload", "$.message.props"), "$.k").cast("bigint")
    return got.select(c("id").cast("bigint").alias("event_id"), landed.reduced(c("payload")).alias("m"), k.alias("k")).select("event_id", "m.year", "m.first_author", "m.crossref_citations", "k")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Server ' || page_id WHEN page_id % 3 = 1 THEN 'Publisher' END AS venue FROM pages")
def s42_preprint_venue(t):
    i = c("page_id")
    inst = F.when(i % 3 == 0, F.concat(lit('"institution":[{"name":" Server '), i.cast("string"), lit('"}],'))).otherwise("")
    payload = F.concat(lit('{"message":{'), inst, lit('"publisher":"Publisher","type":"'), F.when(i % 3 == 2, "journal-article").otherwise("posted-content"), lit('"}}'))
    return t.pages.select("page_id", landed.preprint_venue(payload).alias("venue"))


@query("SELECT c_custkey::VARCHAR AS id, '10.1/c' || c_custkey AS doi, 'Name' || c_custkey AS author, c_mktsegment AS venue, c_nationkey::BIGINT AS cites, c_custkey // 50 AS page FROM customer WHERE c_custkey // 50 >= 1")
def s43_work_record(t):
    """Works of landed pages from the second page on: the first is never opened."""
    i = c("c_custkey").cast("string")
    answer = F.concat(lit('{"doi":"https://doi.org/10.1/C'), i, lit('","authorships":[{"author":{"display_name":"A. B. Name'), i, lit('"}}],"primary_location":{"source":{"display_name":"'), "c_mktsegment", lit('"}},"cited_by_count":'), c("c_nationkey").cast("string"), lit("}"))
    path = files.scratch(t.spark) + "/works"
    pages.land(t.customer, F.expr("c_custkey div 50"), c("c_custkey"), answer, path)
    got = pages.read(t.spark, path).where("page >= 1")
    return got.select("id", landed.works(c("payload")).alias("w"), "page").select("id", "w.doi", "w.author", "w.venue", "w.cites", "page")


@query("SELECT 'https://doi.org/10.1/d' || doc_id AS doi, lang AS title FROM documents WHERE doc_id % 2 = 0")
def s45_screening_dump(t):
    i = c("doc_id")
    payload = F.concat(lit('{"title":"'), "lang", lit('","abstract":"'), F.when(i % 2 == 0, "some").otherwise(""), lit('","doi":"10.1/D'), i.cast("string"), lit('"}'))
    return landed.screening(t.documents.select(payload.alias("p")), "p").select("doi", "title")


# ---------------------------------------------------------------- sources and sinks over real files


def _triage_rows(t):
    i = c("c_custkey").cast("string")
    made = {"doi": F.concat(lit(" 10.1/C"), i), "stem": F.concat(lit("s"), i), "year": lit("2001"), "title": F.concat(c("c_name"), lit(' "quoted", and more')), "tier": F.when(c("c_custkey") % 3 == 0, "").otherwise(c("c_mktsegment")), "note": F.when(c("c_custkey") % 2 == 0, "keep").otherwise("")}
    return t.customer.select(*(made.get(x, lit("")).alias(x) for x in files.TRIAGE))


@query("SELECT '10.1/c' || c_custkey AS doi, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS tier, '' AS replacement_doi, CASE WHEN c_custkey % 2 = 0 THEN 'keep' ELSE '' END AS note FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def s12_prior_decisions(t):
    path = files.scratch(t.spark) + "/triage"
    files.write_triage(_triage_rows(t), path)
    return files.read_decisions(t.spark, path).unionByName(files.read_decisions(t.spark, path + "-missing"))


@query("SELECT 's' || c_custkey AS stem, c_name || ' \"quoted\", and more' AS title, '2001' AS year FROM customer")
def s13_triage_table(t):
    path = files.scratch(t.spark) + "/triage"
    files.write_triage(_triage_rows(t), path)
    return files.read_triage(t.spark, path).select("stem", "title", "year")


@query(f"SELECT '{chr(9).join(files.TRIAGE)}' AS line, 1 AS n UNION ALL SELECT tier, count(*) FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS tier FROM customer) GROUP BY 1")
def s14_triage_file(t):
    """The written file's header line, and its rows by their tier field."""
    path = files.scratch(t.spark) + "/triage"
    files.write_triage(_triage_rows(t), path)
    lines = t.spark.read.text(path)
    head = lit("\t".join(files.TRIAGE))
    line = F.when(c("value") == head, head).otherwise(F.get(F.split("value", "\t"), lit(files.TRIAGE.index("tier"))))
    return lines.select(line.alias("line")).groupBy("line").agg(F.count(lit(1)).alias("n"))


def _folder(t):
    """Two files for each supplier, in a folder of its nation, written by the tasks that hold their rows."""
    root = files.scratch(t.spark)
    name = text_of("r", c("s_nationkey"), "/s", c("s_suppkey"))
    xml = t.supplier.select(F.concat(name, lit(".tei.xml")).alias("path"), F.repeat(lit("x"), (c("s_suppkey") % 50 + 1).cast("int")).alias("content"))
    files.write_files(xml.unionByName(t.supplier.select(F.concat(name, lit(".md")).alias("path"), lit("note").alias("content"))), root)
    return root


@query("SELECT 's' || s_suppkey AS stem FROM supplier")
def s26_directory_stems(t):
    return files.stems(t.spark, _folder(t), ".tei.xml", True)


@query("SELECT 'r' || s_nationkey || '/s' || s_suppkey || e.x AS path, CASE WHEN e.x = '.md' THEN 4 ELSE s_suppkey % 50 + 1 END::INT AS size FROM supplier, (VALUES ('.md'), ('.tei.xml')) e(x)")
def s27_tree(t):
    return files.tree(t.spark, _folder(t)).select("path", F.length("content").alias("size"))


@query("SELECT '10.1/c' || c_custkey AS doi, CASE WHEN c_nationkey % 4 > 0 THEN 1990 + c_nationkey END::INT AS year, CASE WHEN c_nationkey % 4 > 0 THEN c_name END AS title FROM customer")
def s28_metadata_cache(t):
    path = files.scratch(t.spark) + "/cache"
    meta = F.when(c("c_nationkey") % 4 > 0, F.struct((1990 + c("c_nationkey")).cast("int").alias("year"), c("c_name").alias("title")))
    files.write_cache(t.customer.select(text_of("10.1/c", c("c_custkey")).alias("doi"), meta.alias("meta")), path)
    return files.read_cache(t.spark, path).select("doi", "meta.year", "meta.title")


@query("SELECT 'run ' || r.k AS project, CASE label % 3 WHEN 0 THEN 'fetched' WHEN 1 THEN 're-linked' ELSE 'gap' END AS kind, count(*) AS n FROM embeddings, (VALUES (1), (2)) r(k) GROUP BY 1, 2")
def s29_append_only_log(t):
    path = files.scratch(t.spark) + "/log"
    part = lambda k: t.embeddings.where(c("label") % 3 == k).select(c("vec_id").cast("string").alias("stem"), lit("").alias("detail"))
    for run in (1, 2):
        files.append_log(files.log_rows(part(0), part(1), part(2), f"run {run}"), path)
    return t.spark.read.parquet(path).groupBy("project", "kind").agg(F.count(lit(1)).alias("n"))


@query("SELECT '- ' || n_name || ' (' || r_name || ')' AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def s32_report_lines(t):
    path = files.scratch(t.spark) + "/report"
    rows = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey"))
    files.report(rows, F.concat(lit("- "), "n_name", lit(" ("), "r_name", lit(")")), ["r_name", "n_name"], path)
    return t.spark.read.text(path).select(c("value").alias("line"))


@query("SELECT '% ' || count(*) || ' entries; do not edit, generate anew' AS text, 1 AS line FROM customer UNION ALL SELECT '@article{c' || c_custkey || ',', 7 * row_number() OVER (ORDER BY 'c' || c_custkey) - 4 FROM customer")
def s33_bibliography(t):
    """The head and the first line of each entry, with their lines in the written file."""
    path = files.scratch(t.spark) + "/bib"
    key = text_of("c", c("c_custkey"))
    files.bibliography(t.customer.select(key.alias("key"), T.plain_entry(key, c("c_name"), lit("A"), lit("2000"), lit("J")).alias("entry")), path)
    return files.in_written_order(t.spark, path).where(c("value").rlike("^[%@]")).select(c("value").alias("text"), "line")


@query("""WITH m AS (SELECT s_suppkey, 'n' || s_nationkey AS project, s_acctbal > 0 AS there FROM supplier WHERE s_nationkey % 5 = 0)
SELECT 's' || s_suppkey AS stem, 's' || s_suppkey || '.xml' AS file, CASE WHEN there THEN 'copied' ELSE 'missing' END AS status, CASE WHEN there THEN length('s' || s_suppkey) + 7 END::BIGINT AS size, there AS found FROM m
UNION ALL SELECT 's' || s_suppkey, 'notes/all.md', 'copied', 4, true FROM m UNION ALL SELECT 'e' || s_suppkey, NULL, 'none listed', NULL, false FROM m""")
def s31_project_export(t):
    """The files of a project, copied out of a library that lacks those of suppliers in debt; found: what stands in the target afterwards."""
    root = files.scratch(t.spark)
    s = text_of("s", c("s_suppkey"))
    own = F.concat(s, lit(".xml"))
    files.write_files(t.supplier.where("s_acctbal > 0").select(own.alias("path"), F.concat(lit("<a>"), s, lit("</a>")).alias("content")), f"{root}/library")
    files.write_files(t.spark.range(1).select(lit("notes/all.md").alias("path"), lit("note").alias("content")), f"{root}/library")
    some = F.when(c("s_nationkey") % 5 == 0, F.array(lit("five"), lit("other")))
    papers = t.supplier.select(s.alias("stem"), F.array(own, lit("notes/all.md")).alias("files"), some.alias("projects"))
    papers = papers.unionByName(t.supplier.select(text_of("e", c("s_suppkey")).alias("stem"), F.array().cast("array<string>").alias("files"), some.alias("projects")))
    done = files.export_project(papers, "five", f"{root}/library", f"{root}/out")
    there = files.tree(t.spark, f"{root}/out").select(c("path").alias("file"), lit(True).alias("_there"))
    return done.join(there, "file", "left").select("stem", "file", "status", "size", F.coalesce("_there", lit(False)).alias("found"))


@query("SELECT count(*) * 2 AS papers, count(*) + count(*) FILTER (s_acctbal > 0) AS copied, count(*) FILTER (s_acctbal <= 0) AS missing FROM supplier WHERE s_nationkey % 5 = 0")
def s31_export_totals(t):
    return files.export_totals(QUERIES["s31_project_export"](t.spark, t.folder))


@query("SELECT n_nationkey, n_nationkey % 4 <> 0 AS available, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS title FROM nation")
def s36_unwrapped_article(t):
    i = c("n_nationkey")
    article = F.concat(lit("<article><front><article-title>"), "n_name", lit("</article-title></front><body><p>x</p></body></article>"))
    raw = F.when(i % 4 == 0, "<pmc-articleset><article><front/></article></pmc-articleset>").when(i % 4 == 1, article).otherwise(F.concat(lit("<pmc-articleset>"), article, lit("</pmc-articleset>")))
    got = t.nation.select("n_nationkey", U.whole_article(raw.cast("binary")).alias("x"))
    return got.select("n_nationkey", c("x").isNotNull().alias("available"), F.when(c("x").isNotNull(), U.article_xml("x")["title"]).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN '10.1/p' || page_id END AS doi, CASE page_id % 3 WHEN 1 THEN 'First' WHEN 2 THEN '' END AS title FROM pages")
def s41_title_search(t):
    i = c("page_id")
    hit = F.concat(lit('{"DOI":"10.1/p'), i.cast("string"), lit('","title":['), F.when(i % 3 == 1, '"First","Second"').otherwise(""), lit("]}"))
    payload = F.concat(lit('{"message":{"items":['), F.when(i % 3 > 0, F.concat(hit, lit(',{"DOI":"other"}'))).otherwise(""), lit("]}}"))
    return t.pages.select("page_id", landed.title_match(payload).alias("m")).select("page_id", "m.doi", "m.title")


@query("SELECT lower(c_name) AS surname, year, row_number() OVER (ORDER BY lower(c_name), year) AS place FROM customer, (VALUES ('1999'), ('2003')) y(year)")
def o07_citation_order(t):
    """The lines of the written report, in the order in which they stand there."""
    rows = t.customer.select(F.lower("c_name").alias("surname"), F.explode(F.array(lit("2003"), lit("1999"))).alias("year"))
    path = files.scratch(t.spark) + "/order"
    files.report(rows, F.concat_ws("\t", "surname", "year"), ["surname", "year"], path)
    v = F.split("value", "\t")
    return files.in_written_order(t.spark, path, "place").select(v[0].alias("surname"), v[1].alias("year"), "place")


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\t\n\v\f\r ]+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, array_to_string(list_slice(string_split(regexp_replace(s, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), 1, 3), ' ') AS lead FROM d""")
def o08_first_three_sentences(t):
    """The first three sentences of every document, white space squeezed."""
    return t.documents.select("doc_id", T.first_sentences(T.squeeze(c("text"))).alias("lead"))


@query("SELECT o_custkey, least(count(*), 8) AS queries FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY 1")
def o09_query_cap(t):
    """Each plan repeats one two-word phrase for each order; the search takes at most eight."""
    name = lambda k: F.translate(k.cast("string"), "0123456789", "abcdefghij")
    twice = F.transform(F.collect_set("o_orderkey"), lambda k: F.concat(lit("wave"), name(k), lit(" cell"), name(k), lit(" the wave"), name(k), lit(" cell"), name(k), lit(" of ")))
    x = t.orders.groupBy("o_custkey").agg(F.array_join(twice, "").alias("plan"))
    return discover.search_queries(x, "o_custkey", c("plan")).groupBy("o_custkey").agg(F.count(lit(1)).alias("queries"))


# ---------------------------------------------------------------- increments


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def x01_incremental_append(t):
    """All events as a stream of files, taken in twice by queries of their own: the second adds nothing."""
    root = files.scratch(t.spark)
    t.events.repartitionByRange(8, "event_id").write.parquet(f"{root}/in")
    for run in (1, 2):
        stream = incremental.file_stream(t.spark, f"{root}/in", t.events.schema, 2)
        incremental.append_new(stream, "event_id", f"{root}/out", f"{root}/checkpoint-{run}").awaitTermination()
    return incremental.appended(t.spark, f"{root}/out", t.events.schema).groupBy("event_type").agg(F.count(lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
