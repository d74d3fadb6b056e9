"""The search index."""

from __future__ import annotations

import uuid

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from ..functions.documents import text_at
from ..operators import search as S
from ..session import shared_folder
from ..streaming import terms as K
from .bindings import Bindings
from .registry import query


@query(
    "search_build_docs", "O-92",
    sql="""SELECT name, 'table' AS kind, CASE WHEN segment <> 'building' THEN '{"owner":"' || owner || '"}' END AS body,
        CASE WHEN segment NOT IN ('machinery', 'furniture') THEN owner WHEN segment = 'furniture' THEN '' END AS user_id,
        segment AS first_tag, false AS has_custkey, CASE WHEN segment = 'household' THEN 'admin' ELSE owner END AS "user", false AS deleted
    FROM v_tables""",
)
def search_build_docs(b: Bindings) -> DataFrame:
    t = b.tables
    body = F.when(F.col("segment") == "building", "{ }").otherwise(F.format_string('{"owner":"%s"}', "owner"))
    entities = t.select(
        "name", F.lit("table").alias("kind"), body.alias("body"),
        F.when(F.col("segment") != "household", F.col("owner")).alias("created_by"),
    )
    docs = S.build_search_docs(entities, b.defs, "run-1", F.lit(0).cast("bigint"))
    found = F.col("searchable")
    return docs.select(
        "name", "kind", "body",
        text_at(found, "owner", "userId").alias("user_id"),
        F.get_json_object(found, "$.tags[0]").alias("first_tag"),
        found.contains("custkey").alias("has_custkey"),
        "user", "deleted",
    )


@query(
    "search_word", "O-93",
    sql="""SELECT name FROM v_docs WHERE NOT deleted AND list_contains(regexp_split_to_array(lower(name || chr(10) || body || chr(10) || "user"), '[^\\p{L}\\p{N}_]+'), 'the')""",
)
def search_word(b: Bindings) -> DataFrame:
    return S.search_docs(b.docs, "The").select("name")


@query(
    "search_word_in_name", "O-93",
    sql="""SELECT name FROM v_docs WHERE NOT deleted AND (source = 'src4'
        OR list_contains(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+'), 'src4'))""",
)
def search_word_in_name(b: Bindings) -> DataFrame:
    return S.search_docs(b.docs, "SRC4").select("name")


@query(
    "search_words", "O-93",
    sql="""WITH words AS (SELECT DISTINCT name, unnest(regexp_split_to_array(lower(name || chr(10) || body || chr(10) || "user"), '[^\\p{L}\\p{N}_]+')) AS term FROM v_docs WHERE NOT deleted)
    SELECT term, count(*) AS docs FROM words
    WHERE term IN (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) FROM benchmark) AND term <> '' GROUP BY 1""",
)
def search_words(b: Bindings) -> DataFrame:
    terms = b.table("benchmark").select(F.explode(S.tokens(F.col("text"))).alias("term"))
    return S.search_terms(b.docs, terms).groupBy("term").agg(F.count("*").alias("docs"))


@query(
    "search_terms_kept", "O-93", "O-102",
    sql="""WITH now AS (SELECT name, body || CASE WHEN source = 'src2' THEN ' Reworded' ELSE '' END AS body FROM v_docs WHERE lang <> 'fr' OR source = 'src1'),
    words AS (SELECT DISTINCT name, unnest(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+')) AS term FROM now)
    SELECT term, count(*) AS docs FROM words
    WHERE (term IN (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) FROM benchmark) OR term = 'reworded') AND term <> '' GROUP BY 1""",
)
def search_terms_kept(b: Bindings) -> DataFrame:
    """Words kept in files, through a batch that rewords, deletes and adds documents, asked for afterwards."""
    folder = f"{shared_folder(b.spark)}/terms-{uuid.uuid4().hex}"
    text, source, lang = F.col("body"), F.col("run"), F.split("name", "/")[1]
    first, parts = b.docs.filter(source != "src3"), K.parts_for(b.docs.count())
    K.start_terms(K.document_terms(first, text, parts), folder, parts)
    gone = (lang == "fr") & (source != "src1")
    changed = (source == "src2") | (source == "src3") | gone
    reworded = F.when(source == "src2", F.concat(text, F.lit(" Reworded"))).otherwise(text)
    old = K.document_terms(first.filter(changed), text, parts)
    new = K.document_terms(b.docs.filter(changed & ~gone), reworded, parts)
    K.update_terms(old, new, folder, 0)
    K.fold_terms(b.spark, folder)
    terms = b.table("benchmark").select(F.explode(S.tokens(F.col("text"))).alias("term")).unionByName(b.spark.range(1).select(F.lit("Reworded").alias("term")))
    return K.read_terms(b.spark, folder, terms).groupBy("term").agg(F.count("*").alias("docs"))


def _roots(b: Bindings) -> tuple[DataFrame, DataFrame]:
    sources = b.docs.select(F.substring_index("name", "/", 1).alias("root"), F.col("run"))
    included = sources.filter("run <> 'src3'").select("root").distinct()
    excluded = b.docs.select(F.substring_index("name", "/", 2).alias("root")).filter(F.col("root").endswith("/de")).distinct()
    return included, excluded


@query(
    "search_docs_under", "O-94",
    sql="SELECT name FROM v_docs WHERE NOT deleted AND source <> 'src3' AND lang <> 'de'",
)
def search_docs_under(b: Bindings) -> DataFrame:
    included, excluded = _roots(b)
    return S.docs_under(b.docs, included, excluded).select("name")


@query(
    "search_unmarked", "O-95",
    sql="""SELECT name FROM v_docs WHERE NOT deleted AND source NOT IN ('src3', 'src1') AND lang <> 'de' AND updated_at <= 2000""",
)
def search_unmarked(b: Bindings) -> DataFrame:
    included, excluded = _roots(b)
    return S.unmarked(b.docs, "src1", F.lit(2000), included, excluded).select("name")


@query(
    "search_reconcile", "O-96", "O-98",
    sql="""WITH stale AS (SELECT *, CASE WHEN lang = 'en' THEN 'database' ELSE 'table' END AS k FROM v_docs
        WHERE NOT deleted AND source NOT IN ('src3', 'src1') AND lang <> 'de' AND updated_at <= 2000),
    gone AS (SELECT name FROM stale WHERE k IN (SELECT k FROM stale GROUP BY k HAVING count(*) <= CASE k WHEN 'database' THEN 10 ELSE 1000000000 END)
        AND doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT name, deleted OR name IN (SELECT name FROM gone) AS deleted, CASE WHEN name IN (SELECT name FROM gone) THEN 'refresh' ELSE "user" END AS "user",
        CASE WHEN name IN (SELECT name FROM gone) THEN 9999 ELSE updated_at END AS updated_at FROM v_docs""",
)
def search_reconcile(b: Bindings) -> DataFrame:
    included, excluded = _roots(b)
    kind = F.when(F.split("name", "/")[1] == "en", "database").otherwise("table")
    docs = b.docs.withColumn("kind", kind)
    labelled = b.table("labels").join(b.table("documents").select("doc_id", "source", "lang"), "doc_id")
    live = labelled.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("name"))
    after = S.reconcile(
        docs, live, "src1", F.lit(2000), included, excluded, "refresh", F.lit(9999).cast("bigint"),
        most={"database": 10, "table": 1_000_000_000},
    )
    return after.select("name", "deleted", "user", "updated_at")


@query(
    "search_reconcile_stores", "O-96",
    sql="""WITH t AS (SELECT *, segment = 'machinery' AND custkey % 100 <= 60 AS gone FROM v_tables),
    d AS (SELECT DISTINCT catalog_name || '/' || database_name AS name FROM v_tables)
    SELECT 'docs' AS store, name AS key, CASE WHEN gone THEN 'deleted by refresh' ELSE 'live' END AS value FROM t
    UNION ALL SELECT 'docs', name || '/d=1', 'live' FROM t WHERE NOT gone
    UNION ALL SELECT 'docs', name, 'live' FROM d
    UNION ALL SELECT 'defs', name, 'table' FROM t WHERE NOT gone
    UNION ALL SELECT 'defs', name || '/d=1', 'partition' FROM t WHERE NOT gone
    UNION ALL SELECT 'tags', name, segment FROM t WHERE NOT gone
    UNION ALL SELECT 'held_back', name, (SELECT count(*) FROM d) || ' unmarked, 3 allowed' FROM d""",
)
def search_reconcile_stores(b: Bindings) -> DataFrame:
    """A reconciliation carried through index, definitions and tags; too many databases are missing at once."""
    t = b.tables
    fixed = {"body": F.lit("{}"), "user": F.lit("admin"), "deleted": F.lit(False)}
    tables = t.select(
        "name", F.lit("table").alias("kind"), (F.col("custkey") % 100).alias("updated_at"), F.when(F.col("segment") == "building", "r1").alias("run")
    )
    parts = tables.select(F.concat("name", F.lit("/d=1")).alias("name"), F.lit("partition").alias("kind"), F.lit(0).cast("bigint").alias("updated_at"), "run")
    homes = t.select(F.concat_ws("/", "catalog_name", "database_name").alias("name")).distinct().select(
        "name", F.lit("database").alias("kind"), F.lit(0).cast("bigint").alias("updated_at"), F.lit("r0").alias("run")
    )
    docs = tables.unionByName(parts).unionByName(homes).withColumns(fixed)
    defs = tables.select("name", F.lit("table").alias("data")).unionByName(parts.select("name", F.lit("partition").alias("data")))
    tags = t.select("name", F.col("segment").alias("tag"))
    live = t.filter("segment <> 'machinery'").select("name")
    roots = t.select(F.col("catalog_name").alias("root")).distinct()
    after = S.reconcile_stores(docs, defs, tags, live, "r1", F.lit(60), roots, None, "refresh", F.lit(9999).cast("bigint"), most={"database": 3})
    said = F.when(F.col("deleted"), F.concat(F.lit("deleted by "), "user")).otherwise("live")
    shown = {"docs": said, "defs": F.col("data"), "tags": F.col("tag"), "held_back": F.col("held_back")}
    every = [after[k].select(F.lit(k).alias("store"), F.col("name").alias("key"), v.alias("value")) for k, v in shown.items()]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@query(
    "search_propagate_uri", "O-97",
    sql="""WITH last AS (SELECT uri, name, n.updated_at FROM v_docs n WHERE run = 'src1' OR lang = 'es'
        QUALIFY row_number() OVER (PARTITION BY uri ORDER BY n.updated_at DESC, name DESC) = 1)
    SELECT d.name, CASE WHEN l.name IS NOT NULL AND l.name <> d.name THEN 'from ' || l.name END AS data_metadata,
        CASE WHEN l.name IS NOT NULL AND l.name <> d.name THEN l.updated_at ELSE d.updated_at END AS updated_at
    FROM v_docs d LEFT JOIN last l ON l.uri = d.uri""",
)
def search_propagate_uri(b: Bindings) -> DataFrame:
    updated = b.docs.filter("run = 'src1' OR name LIKE '%/es/%'").select(
        "name", "uri", F.concat(F.lit("from "), "name").alias("data_metadata"), "user", "updated_at"
    )
    docs = b.docs.withColumn("data_metadata", F.lit(None).cast("string"))
    return S.propagate_same_uri(docs, updated).select("name", "data_metadata", "updated_at")


@query(
    "search_soft_delete", "O-98",
    sql="""SELECT name, deleted OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS deleted,
        CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'me' ELSE "user" END AS "user" FROM v_docs""",
)
def search_soft_delete(b: Bindings) -> DataFrame:
    toxic = b.table("labels").filter("toxic = 1").join(b.table("documents").select("doc_id", "source", "lang"), "doc_id")
    names = toxic.select(F.concat_ws("/", "source", "lang", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("name"))
    return S.soft_delete_docs(b.docs, names, "me", F.lit(1).cast("bigint")).select("name", "deleted", "user")


@query(
    "catalog_traverse", "O-99",
    sql="""WITH entries AS (SELECT catalog_name AS name, 'catalog' AS kind FROM v_tables UNION SELECT catalog_name || '/' || database_name, 'database' FROM v_tables
        UNION SELECT name, 'table' FROM v_tables)
    SELECT name, kind FROM entries WHERE (name = 'asia' OR name LIKE 'asia/%' OR name = 'europe' OR name LIKE 'europe/%')
        AND name <> 'asia/nation_2' AND name NOT LIKE 'asia/nation\\_2/%' ESCAPE '\\'""",
)
def catalog_traverse(b: Bindings) -> DataFrame:
    return S.traverse(b.tables, ["asia", "europe"], ["asia/nation_2"])
