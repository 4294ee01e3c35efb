"""The registered queries of the document and graph operators, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells, keys
from ..operators import batching, catalog, edges, export, rdf_graph, reshape, upsert
from ..operators.dump import dump, restore, restore_units
from ..options import Reshape
from ..scratch import new_folder
from ..sources import documents, rdf_lines, turtle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
LINEITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ORDER = ", ".join(LINEITEM[2:])


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Reshaping, typing and edges

_SHA = "sha256({})"
_EDGE = "sha256('rdf:edge' || chr(0) || {f} || chr(0) || {p} || chr(0) || {t})"


@query(f"""SELECT {_EDGE.format(f="'orders/' || o_orderkey", p="'placed_by'", t="'customer/' || o_custkey")} AS _key,
    'orders/' || o_orderkey AS _from, 'customer/' || o_custkey AS _to, o_orderstatus, o_totalprice FROM orders""")
def edge_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an edge collection from orders to customers: rename, drop, preflight, qualify and key."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("_from"), F.col("o_custkey").cast("string").alias("_to"), "o_orderstatus", "o_totalprice"
    )
    kept = edges.preflight(rows, "orders", "customer")
    return kept.select(keys.edge_key(F.col("_from"), F.lit("placed_by"), F.col("_to")).alias("_key"), "_from", "_to", "o_orderstatus", "o_totalprice")


def _database(spark: SparkSession, *collections: str, kind: str = "document") -> catalog.Database:
    db = catalog.Database(spark, new_folder(spark, "catalog"))
    db.create()
    for name in collections:
        db.ensure_collection(name, kind)
    return db


def _documents(df: DataFrame, ordinal: str, key: str | None = None, **attributes: str) -> DataFrame:
    """Rows to load: documents of the named columns, and their keys."""
    columns = [F.col(c).alias(n) for n, c in attributes.items()]
    keyed = [F.col(key).cast("string").alias("_key")] if key else []
    return df.select(F.col(ordinal).cast("long").alias("ordinal"), *keyed, F.to_json(F.struct(*keyed, *columns)).alias("doc"))


def _attributes(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("doc", schema).alias("d")).select("d.*")


def _customers(spark: SparkSession, sf_dir: str) -> catalog.Database:
    db = _database(spark, "customer")
    db.load("customer", _documents(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", c_custkey="c_custkey", c_name="c_name", c_mktsegment="c_mktsegment", c_acctbal="c_acctbal"))
    return db


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def collection_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loaded collection, exported as JSON lines and read again."""
    folder = new_folder(spark, "export")
    export.write_jsonl(_customers(spark, sf_dir).read("customer"), folder)
    return _attributes(documents.read_jsonl(spark, folder), "c_custkey long, c_name string, c_mktsegment string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000")
def query_bind_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    statement = "SELECT doc FROM customer WHERE get_json_object(doc, '$.c_mktsegment') = :segment AND double(get_json_object(doc, '$.c_acctbal')) > :least"
    return _attributes(_customers(spark, sf_dir).query(statement, {"segment": "BUILDING", "least": 1000}), "c_custkey long, c_name string")


# Loads into a collection


@query("""SELECT user_id, event_type, CAST(coalesce(max(event_id) FILTER (event_id % 2 = 1), max(event_id)) AS BIGINT) AS event_id FROM events GROUP BY 1, 2""")
def load_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each user, with an attribute for each event type: even events are loaded, odd ones patch them."""
    db, df = _database(spark, "users"), table(spark, sf_dir, "events")
    doc = F.concat(F.lit("{"), cells.json_string(F.col("event_type")), F.lit(":"), F.col("event_id").cast("string"), F.lit("}"))
    rows = df.select(F.col("event_id").alias("ordinal"), F.col("user_id").cast("string").alias("_key"), doc.alias("doc"))
    for odd in (0, 1):
        db.load("users", rows.where(F.col("ordinal") % 2 == odd), "update")
    found = db.read("users").select(F.col("_key").cast("long").alias("user_id"), F.explode(F.from_json("doc", "map<string,string>")).alias("event_type", "event_id"))
    return found.withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT c_mktsegment, 2 * count(*) AS n, 2 * count(*) AS keys FROM customer GROUP BY 1")
def load_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents without keys, loaded twice: each row stays."""
    db, rows = _database(spark, "segments"), _documents(table(spark, sf_dir, "customer"), "c_custkey", c_mktsegment="c_mktsegment")
    for _ in range(2):
        db.load("segments", rows)
    got = db.read("segments").select("_key", F.get_json_object("doc", "$.c_mktsegment").alias("c_mktsegment"))
    return got.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.countDistinct("_key").alias("keys"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def load_replace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a key's rows the last by ordinal stays."""
    db = _database(spark, "last")
    db.load("last", _documents(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", o_custkey="o_custkey", o_orderkey="o_orderkey", o_orderstatus="o_orderstatus"), "replace")
    return _attributes(db.read("last"), "o_custkey long, o_orderkey long, o_orderstatus string")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def load_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order once; a second load of the even ones is refused row by row."""
    db, orders = _database(spark, "orders"), table(spark, sf_dir, "orders")
    rows = _documents(orders, "o_orderkey", "o_orderkey", o_orderkey="o_orderkey", o_custkey="o_custkey", o_orderstatus="o_orderstatus")
    db.load("orders", rows)
    db.load("orders", rows.where("ordinal % 2 = 0").withColumn("doc", F.lit("{}")))
    return _attributes(db.read("orders"), "o_orderkey long, o_custkey long, o_orderstatus string")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'was ' || o_orderstatus ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS o_orderpriority FROM orders""")
def load_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order, and then a patch of each third one: one attribute over another, and one more."""
    db, orders = _database(spark, "orders"), table(spark, sf_dir, "orders")
    db.load("orders", _documents(orders, "o_orderkey", "o_orderkey", o_orderkey="o_orderkey", o_custkey="o_custkey", o_orderstatus="o_orderstatus"))
    patch = orders.where("o_orderkey % 3 = 0").withColumn("status", F.concat(F.lit("was "), "o_orderstatus"))
    db.load("orders", _documents(patch, "o_orderkey", "o_orderkey", o_orderstatus="status", o_orderpriority="o_orderpriority"), "update")
    return _attributes(db.read("orders"), "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")


@query("SELECT o_orderkey, 'customer/' || o_custkey AS _to, o_orderstatus FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def dump_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document and an edge collection, dumped and restored into another catalog."""
    db = _database(spark, "customer")
    db.ensure_collection("orders", "edge")
    db.load("customer", _documents(table(spark, sf_dir, "customer"), "c_custkey", "c_custkey", name="c_name"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").cast("string").alias("_key"), F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("_from"),
        F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("_to"), F.to_json(F.struct(F.col("o_orderstatus").alias("name"))).alias("doc"),
    )
    db.load("orders", orders)
    folder, root = new_folder(spark, "dump"), new_folder(spark, "restored")
    dump([db], folder, codec="gzip")
    restore(spark, root, folder)
    back = catalog.Database(spark, root)
    key, name = F.col("_key").cast("long").alias("o_orderkey"), F.get_json_object("doc", "$.name").alias("o_orderstatus")
    return back.read("orders").select(key, "_to", name).unionByName(back.read("customer").select(key, F.lit(None).cast("string").alias("_to"), name))


@query("""SELECT 'customer' AS name, 'document' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'nation', 'document', count(*) FROM nation
    UNION ALL SELECT 'placed', 'edge', count(*) FROM customer UNION ALL SELECT 'region', 'document', count(*) FROM region""")
def graph_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named graph creates the collections that it lacks; they are loaded and counted."""
    db = _database(spark)
    db.create_graph("g", ["placed:customer->nation"], ["region"])
    customers = table(spark, sf_dir, "customer")
    db.load("customer", _documents(customers, "c_custkey", "c_custkey", c_name="c_name"))
    db.load("nation", _documents(table(spark, sf_dir, "nation"), "n_nationkey", "n_nationkey", n_name="n_name"))
    db.load("region", _documents(table(spark, sf_dir, "region"), "r_regionkey", "r_regionkey", r_name="r_name"))
    ends = [F.concat(F.lit(f"{kind}/"), F.col(c).cast("string")).alias(end) for end, kind, c in (("_from", "customer", "c_custkey"), ("_to", "nation", "c_nationkey"))]
    db.load("placed", customers.select(F.col("c_custkey").alias("ordinal"), F.col("c_custkey").cast("string").alias("_key"), *ends, F.lit("{}").alias("doc")))
    counts = [db.read(r.name).agg(F.count("*").alias("n")).select(F.lit(r.name).alias("name"), F.lit(r.kind).alias("kind"), "n") for r in db.inventory().collect()]
    return reduce(DataFrame.unionByName, counts)


# Files written and read again


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS ordinal FROM customer")
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{new_folder(spark, 'array')}.json"
    export.write_single(_documents(table(spark, sf_dir, "customer"), "c_custkey", c_custkey="c_custkey", c_name="c_name"), path, "json")
    return documents.read_json_array(spark, path).select("ordinal", F.from_json("doc", "c_custkey long, c_name string").alias("d")).select("d.*", "ordinal")


@query("SELECT doc_id, text, lang FROM documents")
def csv_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, with their quotes, commas and line ends, written as CSV and read again; no text here begins like a formula."""
    folder = new_folder(spark, "csv")
    df = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    df.write.csv(folder, header=True, quote='"', escape='"', quoteAll=True)
    return documents.read_delimited(spark, folder).withColumn("doc_id", F.col("doc_id").cast("long"))


_TOKEN_SQL = """SELECT unnest(['', ' 5 ', '1d', 'true', 'null', lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '+' || c_custkey, '-' || c_custkey, '-0', '0.' || c_custkey,
    '00.5', c_custkey || 'e3', c_custkey || '.', '.5', '1_000', '0x10', '1e400', '9223372036854775808', c_name, 'Infinity', 'TRUE']) AS v FROM customer"""
_TAG_SQL = r"""CASE WHEN v = '' OR v = 'null' THEN 'null' WHEN v IN ('true', 'false') THEN 'bool'
    WHEN regexp_matches(v, '\A[+-]?0[^.eE]') THEN 'str'
    WHEN regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(v AS BIGINT) IS NOT NULL THEN 'int'
    WHEN regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(v AS DOUBLE)) THEN 'float' ELSE 'str' END"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    fixed = {x: F.lit(x) for x in ("", " 5 ", "1d", "true", "null", "-0", "00.5", ".5", "1_000", "0x10", "1e400", "9223372036854775808", "Infinity", "TRUE")}
    made = [F.lpad(k, 6, "0"), F.concat(F.lit("+"), k), F.concat(F.lit("-"), k), F.concat(F.lit("0."), k), F.concat(k, F.lit("e3")), F.concat(k, F.lit(".")), F.col("c_name")]
    return table(spark, sf_dir, "customer").select(F.explode(F.array(*fixed.values(), *made)).alias("v"))


@query(f"SELECT v, {_TAG_SQL} AS tag FROM ({_TOKEN_SQL})")
def infer_scalar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("v", cells.cell_tag(F.col("v")).alias("tag"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS number, 'int' AS tag FROM lineitem")
def coerce_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.col("l_linenumber").cast("string"), 5, "0").alias("raw"))
    cell = cells.coerced_number(F.col("raw"), "raw")
    return raw.select("l_orderkey", "l_linenumber", cell["s"].alias("number"), cell["t"].alias("tag"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'true' ELSE 'false' END AS good FROM labels")
def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", cells.coerced_boolean(F.col("quality").cast("string"), "quality")["s"].alias("good"))


@query("SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS _key, 'str' AS key_tag, CAST(p_size AS VARCHAR) AS size, 'int' AS size_tag FROM part")
def reserved_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("id"), F.col("p_size").cast("string").alias("size"))
    typed = reshape.typed_cells(rows, Reshape(translate=("id=_key",), datatypes=("id=number",)))
    return typed.select(F.col("_key.s").alias("_key"), F.col("_key.t").alias("key_tag"), F.col("size.s").alias("size"), F.col("size.t").alias("size_tag"))


@query("SELECT l_orderkey || '_' || l_linenumber AS _key, CAST(l_partkey AS VARCHAR) AS part FROM lineitem")
def merge_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    typed = reshape.typed_cells(rows, Reshape(merge=("_key=[l_orderkey]_[l_linenumber]",), remove=("l_orderkey", "l_linenumber"), translate=("l_partkey=part",)))
    return typed.select(F.col("_key.s").alias("_key"), F.col("part.s").alias("part"))


@query("SELECT o_orderkey || '-' || coalesce(nullif(o_orderstatus, 'P'), '') || '-x' AS tag FROM orders")
def merge_null_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return reshape.typed_cells(rows, Reshape(merge=("tag=[k]-[s]-x",))).select(F.col("tag.s").alias("tag"))


@query("""SELECT '{"age":' || c_nationkey || ',"name":"' || c_name || '"}' AS doc FROM customer""")
def document_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("years"))
    return reshape.to_documents(reshape.typed_cells(rows, Reshape(translate=("years=age",))))


@query("""SELECT CASE WHEN o_custkey % 10 = 0 OR o_orderkey % 7 = 0 THEN 'skip' ELSE 'present' END AS edge_class, count(*) AS n FROM orders GROUP BY 1""")
def edge_skip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    start = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select(start.alias("_from"), end.alias("_to"))
    return edges.classify(rows, "orders", "customer").groupBy("edge_class").agg(F.count("*").alias("n"))


@query("""SELECT edge_class, count(*) AS n FROM (SELECT CASE o_orderkey % 6
    WHEN 0 THEN 'skip' WHEN 1 THEN '_to: edge document is missing ''_to''' WHEN 2 THEN '_to: must be a string'
    WHEN 3 THEN '_from: is not a fully-qualified document id' WHEN 4 THEN 'skip' ELSE 'present' END AS edge_class FROM orders) GROUP BY 1""")
def edge_document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    whole = F.concat(F.lit('{"_from":"orders/'), k, F.lit('","_to":"customer/'), c, F.lit('"}'))
    kinds = [
        F.concat(F.lit('{"_from":"orders/'), k, F.lit('","_to":null}')), F.concat(F.lit('{"_from":"orders/'), k, F.lit('"}')),
        F.concat(F.lit('{"_from":"","_to":'), c, F.lit("}")), F.concat(F.lit('{"_from":"'), k, F.lit('","_to":""}')),
        F.concat(F.lit('{"_from":"","_to":"customer/'), c, F.lit('"}')), whole,
    ]
    doc = F.element_at(F.array(*kinds), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return edges.classify_documents(table(spark, sf_dir, "orders").select(doc.alias("doc"))).groupBy("edge_class").agg(F.count("*").alias("n"))


@query("""SELECT 'lineitem/' || l_orderkey AS _from, CASE WHEN l_partkey % 2 = 0 THEN 'part/' || l_partkey ELSE 'other/' || l_partkey END AS _to FROM lineitem""")
def edge_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey").cast("string")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("_from"), F.when(F.col("l_partkey") % 2 == 0, part).otherwise(F.concat(F.lit("other/"), part)).alias("_to"))
    return edges.preflight(rows, "lineitem", "part")


# Duplicates, batches and checkpoints

_FIRST = f"SELECT {', '.join(LINEITEM)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS rn FROM lineitem) WHERE rn = 1"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINEITEM)


@query(_FIRST)
def dup_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.first_of_key(_lineitem(spark, sf_dir), LINEITEM[:2], LINEITEM[2:])


@query("""SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS created, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS ignored,
    count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS errors FROM lineitem""")
def dup_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lineitem(spark, sf_dir)
    return upsert.load_counts(df.limit(0), df, LINEITEM[:2], "error")


@query(f"SELECT {', '.join(LINEITEM)} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in LINEITEM[2:])}) AS rn FROM lineitem) WHERE rn = 1")
def dup_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.last_of_key(_lineitem(spark, sf_dir), LINEITEM[:2], LINEITEM[2:])


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value,
    arg_max(props, event_id) FILTER (event_id % 3 <> 0) AS props FROM events GROUP BY 1, 2""")
def dup_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("props"))
    return upsert.patch_of_key(df, ["user_id", "event_type"], ["event_id"])


def _upserted(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
        is_stored = F.coalesce(F.expr("event_id % 2 = 0 AND user_id % 3 <> 0"), F.lit(False))
        stored = upsert.first_of_key(df.where(is_stored), ["user_id", "event_type"], ["event_id"])
        return upsert.upsert(stored, df.where(~is_stored), ["user_id", "event_type"], ["event_id"], mode)

    return run


# Every event is on one side: what is not stored is incoming, so even ids of every third user meet no stored row.
_STORED = "stored AS (SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_id % 2 = 0 AND user_id % 3 <> 0 GROUP BY 1, 2)"
_NEW = "new AS (SELECT user_id, event_type, {f}(event_id) AS event_id, arg_{f}(value, event_id) AS value FROM events WHERE NOT coalesce(event_id % 2 = 0 AND user_id % 3 <> 0, false) GROUP BY 1, 2)"
for _mode, _f, _keep in (("ignore", "min", "stored"), ("error", "min", "stored"), ("replace", "max", "new"), ("update", "max", "new")):
    _other = "new" if _keep == "stored" else "stored"
    for _name in (f"upsert_{_mode}", f"upsert_{_mode}_whole"):
        QUERIES[_name] = _upserted(_mode)
        ORACLE_SQL[_name] = f"WITH {_STORED}, {_NEW.format(f=_f)} SELECT * FROM {_keep} UNION ALL SELECT o.* FROM {_other} o ANTI JOIN {_keep} k USING (user_id, event_type)"

_DOC = """'{"key":' || c_custkey || ',"name":"' || c_name || '","segment":"' || c_mktsegment || '"}'"""


def _customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    doc = F.concat(F.lit('{"key":'), k, F.lit(',"name":"'), "c_name", F.lit('","segment":"'), "c_mktsegment", F.lit('"}'))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), doc.alias("doc"))


@query(f"""WITH RECURSIVE x AS (SELECT c_custkey AS ordinal, row_number() OVER (ORDER BY c_custkey) AS rn, octet_length(encode({_DOC})) AS n FROM customer),
    r AS (SELECT rn, ordinal, n + 1 AS bytes, 1 AS docs, CAST(1 AS BIGINT) AS batch_index FROM x WHERE rn = 1 UNION ALL
          SELECT x.rn, x.ordinal, CASE WHEN r.bytes + x.n + 1 > 4000 OR r.docs >= 50 THEN x.n + 1 ELSE r.bytes + x.n + 1 END,
                 CASE WHEN r.bytes + x.n + 1 > 4000 OR r.docs >= 50 THEN 1 ELSE r.docs + 1 END,
                 CASE WHEN r.bytes + x.n + 1 > 4000 OR r.docs >= 50 THEN r.batch_index + 1 ELSE r.batch_index END FROM r JOIN x ON x.rn = r.rn + 1)
    SELECT ordinal, batch_index FROM r""")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.assign_batches(_customer_docs(spark, sf_dir), max_bytes=4000, max_docs=50).select("ordinal", "batch_index")


@query("SELECT event_id, props, (row_number() OVER (ORDER BY event_id) - 1) // 700 + 1 AS batch_index FROM events")
def batch_docs_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.docs_only_batches(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", 700)


@query(f"""WITH RECURSIVE x AS (SELECT c_custkey AS ordinal, row_number() OVER (ORDER BY c_custkey) AS rn, octet_length(encode({_DOC})) + 1 AS n FROM customer),
    r AS (SELECT rn, ordinal, CAST(0 AS BIGINT) AS part, n AS bytes FROM x WHERE rn = 1 UNION ALL
          SELECT x.rn, x.ordinal, CASE WHEN r.bytes >= 4000 THEN r.part + 1 ELSE r.part END, CASE WHEN r.bytes >= 4000 THEN x.n ELSE r.bytes + x.n END FROM r JOIN x ON x.rn = r.rn + 1)
    SELECT ordinal, part FROM r""")
def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.assign_parts(_customer_docs(spark, sf_dir), part_bytes=4000).select("ordinal", "part")


@query(f"""WITH RECURSIVE x AS (SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) AS rn, octet_length(encode({_DOC})) + 1 AS n FROM customer),
    r AS (SELECT rn, key, CAST(0 AS BIGINT) AS part, n AS bytes FROM x WHERE rn = 1 UNION ALL
          SELECT x.rn, x.key, CASE WHEN r.bytes >= 4000 THEN r.part + 1 ELSE r.part END, CASE WHEN r.bytes >= 4000 THEN x.n ELSE r.bytes + x.n END FROM r JOIN x ON x.rn = r.rn + 1)
    SELECT key, CAST(part AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY part ORDER BY key) - 1 AS BIGINT) AS place FROM r""")
def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in compressed parts with a manifest, verified and read again."""
    folder = new_folder(spark, "parts")
    manifest = export.write_parts(_customer_docs(spark, sf_dir), folder, "customers", codec="gzip", threshold=4000)
    parts = export.read_parts(spark, folder, manifest)
    return parts.select(F.get_json_object("doc", "$.key").cast("long").alias("key"), "part", F.col("ordinal").alias("place"))


@query("SELECT event_id, props, (row_number() OVER (ORDER BY event_id) - 1) // 700 + 1 AS batch_index FROM events QUALIFY batch_index > 2")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.skip_committed(batch_docs_cap(spark, sf_dir), 2)


@query("SELECT CAST(min(n) AS BIGINT) - 1 AS committed_batches FROM range(1, 1000) t(n) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 17 <> 9 AND c_custkey % 100 = n)")
def checkpoint_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").where("c_custkey % 17 <> 9 AND c_custkey % 100 > 0").select((F.col("c_custkey") % 100).alias("batch_index"))
    return upsert.contiguous_prefix(done)


# Cells on export

_LEAD = "(['=', '+', '-', '@', chr(9), chr(13), '', 'x'])[CAST(doc_id % 8 AS INTEGER) + 1]"


@query(f"SELECT doc_id, CASE WHEN doc_id % 8 < 6 THEN '''' ELSE '' END || {_LEAD} || text AS cell FROM documents")
def csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ("=", "+", "-", "@", "\t", "\r", "", "x"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", cells.guarded_csv(F.concat(lead, "text")).alias("cell"))


QUERIES["csv_guard_whole"], ORACLE_SQL["csv_guard_whole"] = csv_guard, ORACLE_SQL["csv_guard"]  # its earlier name


@query("""SELECT CAST(c_custkey AS VARCHAR) || ',' || CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '"a,b ""' || c_name || repeat(chr(34), 3) ELSE '''=' || c_name END
    || ',-' || (c_nationkey + 1) || ',' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE '' END AS doc FROM customer""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "null").when(k % 4 == 1, F.concat(F.lit('"a,b \\"'), "c_name", F.lit('\\""'))).otherwise(F.concat(F.lit('"='), "c_name", F.lit('"')))
    doc = F.concat(F.lit('{"k":'), k.cast("string"), F.lit(',"name":'), name, F.lit(',"n":-'), (F.col("c_nationkey") + 1).cast("string"), F.when(k % 2 == 0, F.lit(',"ok":true}')).otherwise(F.lit("}")))
    return export.csv_lines(table(spark, sf_dir, "customer").select(doc.alias("doc")), ["k", "name", "n", "ok"])


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    folder = new_folder(spark, "jsonl")
    df = table(spark, sf_dir, "conversations")
    export.write_jsonl(df.select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("doc")), folder, "gzip")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return _attributes(documents.read_jsonl(spark, folder), f"conv_id {types['conv_id']}, turn {types['turn']}, role string, text string")


# RDF

_B = "http://example.org/"


def _iri(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{_B}{kind}/"), F.col(column).cast("string"))


def _triples(df: DataFrame, ordinal: str, subject: Column, predicate: str, o_kind: str, value: Column, datatype: str | None = None, graph: Column | None = None, s_kind: str = "iri") -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.col(ordinal).cast("long").alias("ordinal"), F.lit(s_kind).alias("s_kind"), subject.alias("s_value"), F.lit(_B + predicate).alias("predicate"),
        F.lit(o_kind).alias("o_kind"), value.alias("o_value"), (F.lit(datatype) if datatype else none).cast("string").alias("o_datatype"), none.alias("o_language"),
        (graph if graph is not None else none).alias("graph"),
    )


def _nation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    return _triples(df, "n_nationkey", _iri("nation", "n_nationkey"), "in", "iri", _iri("region", "n_regionkey"))


_IRI_KEY = "sha256('rdf:iri' || chr(0) || iri)"


@query(f"""SELECT 'nodes' AS collection, {_IRI_KEY} AS _key, iri FROM (SELECT '{_B}nation/' || n_nationkey AS iri FROM nation
    UNION SELECT '{_B}region/' || n_regionkey FROM nation)""")
def rdf_iri_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf_graph.vertices(_nation_triples(spark, sf_dir)).select("collection", "_key", "iri")


def _id(kind: str, column: str) -> str:
    return f"'nodes/' || sha256('rdf:iri' || chr(0) || '{_B}{kind}/' || {column})"


@query(f"""SELECT {_EDGE.format(f="_from", p="predicate", t="_to")} AS _key, _from, _to, predicate FROM (
    SELECT {_id("nation", "n_nationkey")} AS _from, {_id("region", "n_regionkey")} AS _to, '{_B}in' AS predicate FROM nation)""")
def rdf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf_graph.edges(_nation_triples(spark, sf_dir)).select("_key", "_from", "_to", "predicate")


def _customer_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    segment = _iri("segment", "c_mktsegment")
    return _triples(df, "c_custkey", segment, "latest", "literal", F.col("c_name")).unionByName(_triples(df, "c_custkey", segment, "nation", "literal", F.col("c_nationkey").cast("string")))


@query(f"""SELECT sha256('rdf:iri' || chr(0) || iri) AS _key, iri, latest, nation FROM (SELECT '{_B}segment/' || c_mktsegment AS iri, arg_max(c_name, c_custkey) AS latest,
    CAST(arg_max(c_nationkey, c_custkey) AS VARCHAR) AS nation FROM customer GROUP BY 1)""")
def rdf_literal_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rdf_graph.vertices(_customer_literals(spark, sf_dir), rdf_graph.Fold(literals="vertex-property"))
    return rows.select("_key", "iri", F.col("properties")[_B + "latest"].alias("latest"), F.col("properties")[_B + "nation"].alias("nation"))


@query("""SELECT 'nodes' AS collection, sha256('rdf:literal' || chr(0) || v || chr(0) || dt || chr(0)) AS _key, v AS literal, nullif(dt, '') AS datatype FROM (
    SELECT DISTINCT p_brand AS v, '' AS dt FROM part UNION SELECT DISTINCT CAST(p_size AS VARCHAR), 'http://www.w3.org/2001/XMLSchema#integer' FROM part)""")
def rdf_literal_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, subject = table(spark, sf_dir, "part"), _iri("part", "p_partkey")
    triples = _triples(df, "p_partkey", subject, "brand", "literal", F.col("p_brand")).unionByName(
        _triples(df, "p_partkey", subject, "size", "literal", F.col("p_size").cast("string"), turtle.XSD + "integer")
    )
    return rdf_graph.vertices(triples, rdf_graph.Fold(literals="materialize")).where("literal IS NOT NULL").select("collection", "_key", "literal", "datatype")


@query(f"""SELECT 'g_URIRef' AS collection, sha256('rdf:iri' || chr(0) || '{_B}supplier/' || s_suppkey) AS _key FROM supplier
    UNION ALL SELECT DISTINCT 'g_Literal', sha256('rdf:literal' || chr(0) || s_name || chr(0) || chr(0)) FROM supplier
    UNION ALL SELECT DISTINCT 'g_BNode', sha256('rdf:bnode' || chr(0) || 'n' || s_nationkey) FROM supplier""")
def rdf_rpt_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, subject = table(spark, sf_dir, "supplier"), _iri("supplier", "s_suppkey")
    triples = _triples(df, "s_suppkey", subject, "name", "literal", F.col("s_name")).unionByName(
        _triples(df, "s_suppkey", subject, "at", "bnode", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    )
    return rdf_graph.vertices(triples, rdf_graph.Fold(topology="rpt", vertices="g")).select("collection", "_key")


@query("""SELECT scope, sha256('rdf:bnode' || chr(0) || scope || chr(0) || label) AS _key, label FROM (
    SELECT DISTINCT 'e' || event_type AS label FROM events), (VALUES ('a.nq'), ('b.nq')) t(scope)""")
def rdf_bnode_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    triples = _triples(df, "event_id", F.concat(F.lit("e"), "event_type"), "by", "literal", F.col("user_id").cast("string"), s_kind="bnode")
    both = [rdf_graph.vertices(triples, rdf_graph.Fold(scope=s)).select("scope", "_key", "label") for s in ("a.nq", "b.nq")]
    return both[0].unionByName(both[1])


def _order_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(_B + "status/"), "o_orderstatus"))
    return _triples(table(spark, sf_dir, "orders"), "o_orderkey", _iri("order", "o_orderkey"), "by", "iri", _iri("customer", "o_custkey"), graph=graph)


_ORDER_ENDS = f"{_id('order', 'o_orderkey')} AS _from, {_id('customer', 'o_custkey')} AS _to, CASE WHEN o_orderstatus <> 'P' THEN '{_B}status/' || o_orderstatus END AS graph"


@query(f"""SELECT CASE WHEN graph IS NULL THEN {_EDGE.format(f="_from", p=f"'{_B}by'", t="_to")} ELSE {_EDGE.format(f="_from", p=f"'{_B}by'", t="_to")[:-1]} || chr(0) || graph) END AS _key,
    _from, _to, graph FROM (SELECT {_ORDER_ENDS} FROM orders)""")
def rdf_named_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf_graph.edges(_order_quads(spark, sf_dir), rdf_graph.Fold(graphs="property")).select("_key", "_from", "_to", "graph")


@query(f"""SELECT coalesce('links_' || substr(regexp_replace(graph, '[^A-Za-z0-9]', '_', 'g'), 1, 48) || '_' || substr(sha256('rdf:graph' || chr(0) || graph), 1, 8), 'links') AS collection,
    count(*) AS n FROM (SELECT {_ORDER_ENDS} FROM orders) GROUP BY 1""")
def rdf_graph_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf_graph.edges(_order_quads(spark, sf_dir), rdf_graph.Fold(graphs="collection")).groupBy("collection").agg(F.count("*").alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS triples_read, (SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_custkey) FROM orders) AS vertices_built, (SELECT count(*) FROM orders) AS edges_built""")
def rdf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdf_graph.summary(_order_quads(spark, sf_dir))


@query(f"""SELECT '{_B}order/' || o_orderkey AS s_value, '{_B}by' AS predicate, '{_B}customer/' || o_custkey AS o_value, '{_B}status/' || o_orderstatus AS graph FROM orders""")
def rdf_nquads_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string(f"<{_B}order/%d> <{_B}by> <{_B}customer/%d> <{_B}status/%s> .", "o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), line.alias("value"))
    return rdf_lines.parse_statements(lines, quads=True, ordinal_col="n").select("s_value", "predicate", "o_value", "graph")


@query(f"""SELECT 'bnode' AS s_kind, 'd' || doc_id AS s_value, 'literal' AS o_kind, text AS o_value, CAST(NULL AS VARCHAR) AS o_datatype, lang AS o_language FROM documents
    UNION ALL SELECT 'iri', '{_B}doc/' || doc_id, 'literal', CAST(n_chars AS VARCHAR), 'http://www.w3.org/2001/XMLSchema#integer', NULL FROM documents""")
def rdf_ntriples_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    df = table(spark, sf_dir, "documents")
    first = df.select(F.col("doc_id").alias("n"), F.concat(F.lit("_:d"), F.col("doc_id").cast("string"), F.lit(f' <{_B}text> "'), text, F.lit('"@'), "lang", F.lit(" . # end")).alias("value"))
    second = df.select(F.col("doc_id").alias("n"), F.format_string(f'<{_B}doc/%d> <{_B}size> "%d"^^<{turtle.XSD}integer>.', "doc_id", "n_chars").alias("value"))
    parsed = rdf_lines.parse_statements(first.unionByName(second), quads=False, ordinal_col="n")
    return parsed.select("s_kind", "s_value", "o_kind", "o_value", "o_datatype", "o_language")


QUERIES["rdf_ntriples_parse_whole"], ORACLE_SQL["rdf_ntriples_parse_whole"] = rdf_ntriples_parse, ORACLE_SQL["rdf_ntriples_parse"]  # its earlier name


@query(f"""SELECT '{_B}nation/' || n_nationkey AS s_value, '{_B}in' AS predicate, '{_B}region/' || n_regionkey AS o_value, CAST(NULL AS VARCHAR) AS o_datatype FROM nation
    UNION ALL SELECT '{_B}nation/' || n_nationkey, '{_B}number', CAST(n_nationkey AS VARCHAR), 'http://www.w3.org/2001/XMLSchema#integer' FROM nation""")
def turtle_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.format_string("@prefix x: <" + _B + "nation/> .\nPREFIX r: <" + _B + "region/>\nx:%d <" + _B + "in> r:%d ; <" + _B + "number> %d .\n", "n_nationkey", "n_regionkey", "n_nationkey")
    texts = table(spark, sf_dir, "nation").select(body.alias("value"))
    return turtle.parse_documents(texts).select("s_value", "predicate", "o_value", "o_datatype")


# Catalog metadata

_NAME = "CASE WHEN c_custkey % 10 = 0 THEN '_' ELSE '' END || c_mktsegment || '_' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '_tmp' ELSE '' END"


@query(f"SELECT name FROM (SELECT {_NAME} AS name FROM customer) WHERE left(name, 1) <> '_' AND regexp_matches(name, '[13]|BU') AND NOT regexp_matches(name, '_tmp$')")
def collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.expr(_NAME).alias("name"))
    return catalog.filter_collections(names.withColumn("is_system", F.startswith("name", F.lit("_"))), include="[13]|BU", exclude="_tmp$").select("name")


@query("""SELECT 'v' || c_custkey AS name, 'segment_' || c_mktsegment AS target FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'v' || c_custkey, 'nation_' || c_nationkey FROM customer WHERE c_custkey % 3 < 2""")
def view_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a view for each customer rests on: two links, an index listed twice, or nothing."""
    links = F.format_string('{"links":{"segment_%s":{"fields":{"a":1}},"nation_%d":{}}}', "c_mktsegment", "c_nationkey")
    indexes = F.format_string('{"indexes":[{"collection":"nation_%d"},{"collection":"nation_%d"}]}', "c_nationkey", "c_nationkey")
    kind = F.col("c_custkey") % 3
    doc = F.when(kind == 0, links).when(kind == 1, indexes).otherwise('{"other":1}')
    return catalog.view_targets(table(spark, sf_dir, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("name"), doc.alias("doc")))


@query("""WITH u AS (SELECT o_orderstatus AS database, 'c' || (o_custkey % 50) AS collection, min(o_orderkey) AS position, max(o_custkey % 50 % 3 = 0) AS is_edge FROM orders GROUP BY 1, 2),
    d AS (SELECT database, min(position) AS first FROM u GROUP BY 1)
    SELECT u.database, collection, CAST(row_number() OVER (ORDER BY first, is_edge, position) AS INTEGER) AS step FROM u JOIN d ON u.database = d.database""")
def restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts listed by orders: a database for each status, and collections of both kinds."""
    group = F.col("o_custkey") % 50
    listed = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("position"), F.col("o_orderstatus").alias("database"), F.concat(F.lit("c"), group.cast("string")).alias("collection"), (group % 3 == 0).alias("is_edge")
    )
    step = F.row_number().over(Window.orderBy("database_position", "is_edge", "position"))
    return restore_units(listed).select("database", "collection", step.alias("step"))


# Relational queries over collections: what Spark SQL supplies


@query("""SELECT n_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def sql_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return per.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "orders", "total")


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def sql_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM {orders}) WHERE rn <= 3",
        orders=table(spark, sf_dir, "orders"),
    )


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def sql_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return customer.where("c_acctbal > 0").select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey")).exceptAll(nation.where("n_regionkey = 0").select("n_nationkey"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def sql_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
