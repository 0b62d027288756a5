"""The library's named queries over the driver's tables, and the SQL that each must agree with.

Each query runs an operator over whole tables. Oracles spell the same result in plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config.project import Entity, ForeignKey, Project, Unnest
from .functions import geo
from .functions.predicate import compile_predicate
from .functions.replace import apply_replacements, replaced_counts, unmatched
from .functions.text import normalize_text
from .ingest import submission as eav
from .operators.extra_columns import add_extra_columns
from .operators.filters import apply_filters
from .operators.identity import add_system_id
from .operators.link import Remote, link, map_to_remote
from .operators.reshape import unnest
from .operators.shared import fixed, shared_folder
from .operators.subset import drop_duplicates, drop_empty_rows, fd_violations, select_columns, translate_columns
from .plans.pipeline import duplicate_keys, normalize
from .quality.validators import orphans, validate
from .recon import reconcile
from .service import analysis
from .sinks.writers import table_shapes, write
from .sources.files import read_workbook
from .sources.relational import read_sqlite
from .streaming import stateful
from .streaming.steps import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remote(spark: SparkSession, sf_dir: str, name: str, key: str, public_id: str) -> Remote:
    """A table with system ids in key order, as links see it."""
    return Remote(name, fixed(add_system_id(table(spark, sf_dir, name), [key])), "system_id", public_id)


_NATION = "(SELECT row_number() OVER (ORDER BY n_nationkey) AS nation_id, * FROM nation)"


# projection and derived columns


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def subset_projection(spark, sf_dir):
    return select_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "no_such_column", "o_orderstatus"])


@query(
    "SELECT c_custkey, c_name, 42 AS answer, '=x' AS literal, upper(c_name) || '/' || coalesce(c_mktsegment, '') AS formula,"
    " c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS joined, c_name AS copied, 'plain text' AS plain FROM customer"
)
def extra_columns_all_modes(spark, sf_dir):
    df = select_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    extra = {"answer": 42, "literal": "==x", "formula": "=concat(upper(c_name), '/', c_mktsegment)", "joined": "{c_mktsegment}-{c_nationkey}", "copied": "C_NAME", "plain": "plain text"}
    return add_extra_columns(df, extra)[0].drop("c_mktsegment", "c_nationkey")


def _formula(name: str, source: str):
    def run(spark, sf_dir):
        df = select_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
        return add_extra_columns(df, {name: source})[0].select("p_partkey", name)

    return run


QUERIES["formula_concat"] = _formula("r", "=concat(p_brand, ' ', p_type, null)")
ORACLES["formula_concat"] = "SELECT p_partkey, coalesce(p_brand, '') || ' ' || coalesce(p_type, '') AS r FROM part"
QUERIES["formula_upper_lower_trim"] = _formula("r", "=concat(upper(p_name), '|', lower(p_brand), '|', trim('  x\t'))")
ORACLES["formula_upper_lower_trim"] = "SELECT p_partkey, upper(p_name) || '|' || lower(p_brand) || '|x' AS r FROM part"
QUERIES["formula_substr"] = _formula("r", "=concat(substr(p_name, 2, 3), '|', substr(p_name, -4, 2))")
ORACLES["formula_substr"] = "SELECT p_partkey, substr(p_name, 3, 3) || '|' || substr(p_name, greatest(length(p_name) - 4, 0) + 1, greatest(length(p_name) - 2, 0) - greatest(length(p_name) - 4, 0)) AS r FROM part"
QUERIES["formula_coalesce"] = _formula("r", "=coalesce(null, p_brand, 'none')")
ORACLES["formula_coalesce"] = "SELECT p_partkey, coalesce(p_brand, 'none') AS r FROM part"


@query("SELECT p_partkey, p_brand || '-' || p_size AS label, '{' || p_type || '}' AS braces FROM part")
def interpolation(spark, sf_dir):
    df = select_columns(table(spark, sf_dir, "part"), ["p_partkey", "p_brand", "p_size", "p_type"])
    return add_extra_columns(df, {"label": "{p_brand}-{p_size}", "braces": "{{{p_type}}}"})[0].select("p_partkey", "label", "braces")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def column_translation(spark, sf_dir):
    return translate_columns(table(spark, sf_dir, "nation"), {"n_nationkey": "id", "n_name": "name", "n_regionkey": "id"})


@query("SELECT doc_id, strip_accents(lower(lang || ' ' || source)) AS plain FROM documents")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.concat("lang", F.lit(" "), "source")).alias("plain"))


# filters


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE (l_quantity > 10 AND l_discount <= 0.05 OR l_returnflag IN ('R', 'A'))"
    " AND NOT coalesce(l_linestatus = 'F', false)"
)
def filter_query(spark, sf_dir):
    spec = [{"type": "query", "query": "(l_quantity > 10 and l_discount <= 0.05 or l_returnflag in ['R', 'A']) and l_linestatus != 'F'"}]
    return apply_filters(table(spark, sf_dir, "lineitem"), spec, {}).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND p_brand LIKE 'Brand%' AND p_size BETWEEN 5 AND 30 AND p_retailprice IS NOT NULL")
def filter_query_strings(spark, sf_dir):
    test = compile_predicate("p_name.str.contains('e') and p_brand.str.startswith('Brand') and 5 <= p_size <= 30 and p_retailprice.notna()", table(spark, sf_dir, "part").columns)
    return table(spark, sf_dir, "part").where(test).select("p_partkey", "p_name")


@query("SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
def filter_query_nulls(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return apply_filters(joined, [{"type": "query", "query": "quality != 1"}], {}).select("doc_id", "quality")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey IS NOT DISTINCT FROM o.o_custkey AND c_mktsegment = 'BUILDING')")
def filter_exists_in(spark, sf_dir):
    store = {"customer": table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")}
    spec = [{"type": "exists_in", "column": "o_custkey", "other_entity": "customer", "other_column": "c_custkey"}]
    return apply_filters(table(spark, sf_dir, "orders"), spec, store).select("o_orderkey", "o_custkey")


@query("SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL OR toxic IS NOT NULL")
def filter_drop_empty_rows(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return drop_empty_rows(joined, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


# links


def _customer_nation(how: str):
    """Some nations are left out, and some customers have one that is not there, so that both sides have rows without a partner."""

    def run(spark, sf_dir):
        nation = _remote(spark, sf_dir, "nation", "n_nationkey", "nation_id")
        some = Remote("nation", nation.df.where("n_nationkey >= 5"), "system_id", "nation_id")
        customer = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).otherwise(F.col("c_nationkey") + 100).alias("c_nationkey"))
        fk = ForeignKey.of({"entity": "nation", "local_keys": ["c_nationkey"], "remote_keys": ["n_nationkey"], "how": how, "extra_columns": {"nation_name": "n_name"}})
        return link(customer, fk, some)[0]

    return run


for _how, _join in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("outer", "FULL JOIN")):
    QUERIES[f"fk_{_how}"] = _customer_nation(_how)
    ORACLES[f"fk_{_how}"] = (
        f"SELECT c_custkey, c_nationkey, nation_id, n_name AS nation_name FROM (SELECT c_custkey, c_nationkey + CASE WHEN c_nationkey < 20 THEN 0 ELSE 100 END AS c_nationkey FROM customer) c"
        f" {_join} (SELECT * FROM {_NATION} WHERE n_nationkey >= 5) n ON c_nationkey = n_nationkey"
    )


@query("SELECT a.r_name, b.nation_id FROM region a CROSS JOIN (SELECT nation_id FROM " + _NATION + ") b")
def fk_cross(spark, sf_dir):
    nation = _remote(spark, sf_dir, "nation", "n_nationkey", "nation_id")
    return link(select_columns(table(spark, sf_dir, "region"), ["r_name"]), ForeignKey.of({"entity": "nation", "how": "cross"}), nation)[0]


def _with_nulls(spark, sf_dir, matches: bool) -> DataFrame:
    """Documents' quality (null where unlabelled) against a lookup that has a null key itself."""
    left = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long")), "doc_id", "left")
    lookup = spark.range(1).select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(None))).alias("key")).withColumn("key", F.col("key").cast("long")).withColumn("system_id", F.coalesce(F.col("key"), F.lit(8)) + 1)
    spec = {"entity": "grade", "local_keys": ["quality"], "remote_keys": ["key"], "how": "left"}
    if matches:  # a link on a business key that is the remote's identity is no mere lookup
        return link(left, ForeignKey.of({**spec, "how": "inner"}), Remote("grade", lookup, "system_id", "grade_id"))[0]
    return link(left, ForeignKey.of(spec), Remote("grade", lookup, "system_id", "grade_id"))[0]


_GRADES = "(VALUES (0, 1), (1, 2), (NULL, 9)) AS g(key, grade_id)"


@query(f"SELECT d.doc_id, quality, grade_id FROM documents d LEFT JOIN labels l USING (doc_id) JOIN {_GRADES} ON quality IS NOT DISTINCT FROM key")
def fk_null_matching(spark, sf_dir):
    return _with_nulls(spark, sf_dir, True)


@query(f"SELECT d.doc_id, quality, grade_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN {_GRADES} ON quality = key")
def fk_null_safe(spark, sf_dir):
    return _with_nulls(spark, sf_dir, False)


@query(
    "SELECT c_custkey, nation_id, nation_name, region_id, region_name FROM customer JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) AS nation_id, n_nationkey, n_name AS nation_name, n_regionkey FROM nation)"
    " ON c_nationkey = n_nationkey JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) AS region_id, r_regionkey, r_name AS region_name FROM region) ON n_regionkey = r_regionkey"
)
def fk_chain_extra_columns(spark, sf_dir):
    nation, region = _remote(spark, sf_dir, "nation", "n_nationkey", "nation_id"), _remote(spark, sf_dir, "region", "r_regionkey", "region_id")
    df = select_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey"])
    df, _ = link(df, ForeignKey.of({"entity": "nation", "local_keys": ["c_nationkey"], "remote_keys": ["n_nationkey"], "extra_columns": {"nation_name": "n_name", "n_regionkey": "n_regionkey"}}), nation)
    df, _ = link(df, ForeignKey.of({"entity": "region", "local_keys": ["n_regionkey"], "remote_keys": ["r_regionkey"], "extra_columns": {"region_name": "r_name"}}), region)
    return df.select("c_custkey", "nation_id", "nation_name", "region_id", "region_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS quantity FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber)")
def fk_composite(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    remote = Remote("line", lines.withColumn("system_id", F.lit(1).cast("long")), "system_id", "line_id")
    fk = ForeignKey.of({"entity": "line", "local_keys": ["l_orderkey", "l_linenumber"], "remote_keys": ["l_orderkey", "l_linenumber"], "extra_columns": {"quantity": "l_quantity"}, "drop_remote_id": True})
    return link(select_columns(lines, ["l_orderkey", "l_linenumber"]), fk, remote)[0]


@query(
    "SELECT _merge, count(*) AS n_rows FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS _merge"
    " FROM customer FULL JOIN orders ON c_custkey = o_custkey) GROUP BY 1"
)
def fk_merge_indicator(spark, sf_dir):
    remote = Remote("order", table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("system_id"), "o_custkey"), "system_id", "order_id")
    fk = ForeignKey.of({"entity": "order", "local_keys": ["c_custkey"], "remote_keys": ["o_custkey"], "how": "outer"})
    linked, _ = link(table(spark, sf_dir, "customer").select("c_custkey"), fk, remote, merge_indicator="_merge")
    return linked.groupBy("_merge").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) - count(DISTINCT o_custkey) FROM orders) AS left_repeats, (SELECT count(*) FROM customer) AS right_rows,"
    " (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS left_only,"
    " (SELECT count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)) AS right_only"
)
def constraint_report(spark, sf_dir):
    """The fused counts behind all link constraints."""
    orders = select_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"])
    remote = _remote(spark, sf_dir, "customer", "c_custkey", "customer_id")
    fk = ForeignKey.of({"entity": "customer", "local_keys": ["o_custkey"], "remote_keys": ["c_custkey"], "how": "outer", "constraints": {"cardinality": "many_to_one"}})
    counts = link(orders, fk, remote, "warn")[1].counts
    return spark.range(1).select(*[F.lit(counts[k]).cast("long").alias(k) for k in ("left_rows", "left_repeats", "right_rows", "left_only", "right_only")])


@query(
    "SELECT (SELECT count(*) FROM orders) AS total_rows, (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS matched_rows, 'many_to_one' AS cardinality"
)
def fk_join_stats(spark, sf_dir):
    from .operators.link import join_stats

    remote = Remote("customer", table(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), "c_custkey", "customer_id")
    s = join_stats(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ForeignKey.of({"entity": "customer", "local_keys": ["o_custkey"], "remote_keys": ["c_custkey"]}), remote)
    return spark.range(1).select(F.lit(s["total_rows"]).cast("long").alias("total_rows"), F.lit(s["matched_rows"]).cast("long").alias("matched_rows"), F.lit(s["cardinality"]).alias("cardinality"))


@query("SELECT o_orderkey, o_orderstatus, CAST(CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 20 END AS BIGINT) AS status_id FROM orders")
def map_to_remote_ids(spark, sf_dir):
    return map_to_remote(select_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"]), "o_orderstatus", "status_id", {"F": 10, "O": 20})


@query("SELECT DISTINCT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND lang = 'en')")
def orphan_keys(spark, sf_dir):
    return orphans(table(spark, sf_dir, "labels"), ["doc_id"], table(spark, sf_dir, "documents").where("lang = 'en'"), ["doc_id"])


#: case -> (how, constraints, rows of the remote side); customers are linked to their orders
_CONSTRAINED = {
    "one_to_one": ("left", {"cardinality": "one_to_one"}, "true"),
    "many_to_one": ("left", {"cardinality": "many_to_one"}, "true"),
    "one_to_many": ("inner", {"cardinality": "one_to_many"}, "o_orderkey % 97 = 1"),
    "many_to_many": ("left", {"cardinality": "many_to_many"}, "true"),
    "unmatched_left": ("left", {"allow_unmatched_left": False}, "o_orderkey % 97 = 1"),
    "unmatched_right": ("outer", {"allow_unmatched_right": False}, "true"),
    "row_decrease": ("inner", {"allow_row_decrease": False}, "o_orderkey % 97 = 1"),
    "unique_left": ("left", {"require_unique_left": True}, "true"),
    "unique_right": ("left", {"require_unique_right": True}, "true"),
    "null_keys": ("inner", {"allow_null_keys": False}, "true"),
}


def _constrained_sql() -> str:
    """Each case's counts, and which of the rules they break."""
    cases = []
    for name, (how, _, rows) in _CONSTRAINED.items():
        join = {"left": "LEFT", "inner": "INNER", "outer": "FULL"}[how]
        cases.append(
            f"SELECT '{name}' AS c, (SELECT count(*) FROM customer) AS l, count(*) AS n, sum(CASE WHEN o IS NULL THEN 1 ELSE 0 END) AS lonely_l, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS lonely_r,"
            f" (SELECT count(o_custkey) - count(DISTINCT o_custkey) FROM orders WHERE {rows}) AS rep_r, (SELECT count(*) FROM orders WHERE o_custkey IS NULL AND {rows}) AS nulls"
            f" FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey % 5 = 0) {join} JOIN (SELECT o_custkey AS o FROM orders WHERE {rows}) ON k = o"
        )
    broken = {
        "NOT_UNIQUE_RIGHT": "c IN ('one_to_one', 'many_to_one', 'unique_right') AND rep_r > 0",
        "NOT_ONE_TO_ONE": "c = 'one_to_one' AND n <> l",
        "NOT_MANY_TO_ONE": "c = 'many_to_one' AND n > l",
        "NOT_ONE_TO_MANY": "c = 'one_to_many' AND n < l",
        "UNMATCHED_LEFT": "c = 'unmatched_left' AND lonely_l > 0",
        "UNMATCHED_RIGHT": "c = 'unmatched_right' AND lonely_r > 0",
        "ROWS_LOST": "c = 'row_decrease' AND n < l",
        "NOT_UNIQUE_LEFT": "c = 'unique_left' AND false",  # customers' keys are unique
        "NULL_KEYS": "nulls > 0",
        "ISSUE": "n <> l",
    }
    return "WITH x AS (" + " UNION ALL ".join(cases) + ") " + " UNION ALL ".join(f"SELECT c AS rule, '{code}' AS code FROM x WHERE {test}" for code, test in broken.items())


@query(_constrained_sql())
def link_constraints(spark, sf_dir):
    """What each constraint of a link reports, and the soft issue of rows that a link adds or loses. Some customers' keys are none."""
    key = F.when(F.col("c_custkey") % 5 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    customers, orders = table(spark, sf_dir, "customer").select(key.alias("k")), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("system_id"), "o_custkey")
    found = []
    for name, (how, constraints, rows) in _CONSTRAINED.items():
        fk = ForeignKey.of({"entity": "order", "local_keys": ["k"], "remote_keys": ["o_custkey"], "how": how, "constraints": constraints})
        report = link(customers, fk, Remote("order", orders.where(rows.replace("o_orderkey", "system_id")), "system_id", "order_id"), "warn")[1]
        found += [(name, code) for code, _ in report.violations] + [(name, "ISSUE") for _ in report.issues]
    return spark.createDataFrame(found, "rule string, code string")


@query("SELECT c_custkey, c_name, nation_id, n_name AS c_name_nation FROM customer JOIN " + _NATION + " ON c_nationkey = n_nationkey")
def fk_suffix(spark, sf_dir):
    """A remote column whose name is taken gets the remote entity's name at its end."""
    fk = ForeignKey.of({"entity": "nation", "local_keys": ["c_nationkey"], "remote_keys": ["n_nationkey"], "extra_columns": {"c_name": "n_name"}})
    df = select_columns(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey"])
    return link(df, fk, _remote(spark, sf_dir, "nation", "n_nationkey", "nation_id"))[0].drop("c_nationkey")


@query(
    "SELECT c_custkey, balance, row_number() OVER (ORDER BY c_custkey) AS account_id, row_number() OVER (ORDER BY c_custkey) AS holder_id, row_number() OVER (ORDER BY c_custkey) AS by_balance_id"
    " FROM (SELECT c_custkey, c_acctbal AS balance FROM customer)"
)
def fk_cycle(spark, sf_dir):
    """Customers and accounts link to each other; the deferred link waits until both are built, and its extra column is a third entity's key."""
    holder = {"source": "raw", "public_id": "holder_id", "keys": ["c_custkey"], "columns": ["c_name"]}
    account = {"source": "raw", "public_id": "account_id", "keys": ["number"], "columns": ["number", "c_acctbal"]}
    spec = {
        "holder": {**holder, "foreign_keys": [{"entity": "account", "local_keys": ["c_custkey"], "remote_keys": ["number"], "extra_columns": {"balance": "c_acctbal"}, "defer_dependency": True}]},
        "account": {**account, "foreign_keys": [{"entity": "holder", "local_keys": ["number"], "remote_keys": ["c_custkey"]}, {"entity": "ledger", "local_keys": ["number"], "remote_keys": ["entry"]}]},
        "ledger": {"source": "raw", "public_id": "by_balance_id", "keys": ["entry"], "columns": ["entry"]},
    }
    raw = table(spark, sf_dir, "customer").withColumns({"number": F.col("c_custkey"), "entry": F.col("c_custkey")})
    made = normalize(spark, Project.of({"entities": spec}), None, {"raw": raw}).tables
    return made["holder"].select("c_custkey", "account_id", "balance").join(made["account"].select(F.col("number").alias("c_custkey"), "holder_id", "by_balance_id"), "c_custkey")


@query(
    "SELECT c_custkey, n_name, measure, amount FROM (SELECT c_custkey, n_name, CAST(c_acctbal AS DOUBLE) AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " WHERE c_custkey % 2 = 0 AND n_name > 'E') UNPIVOT INCLUDE NULLS (amount FOR measure IN (balance, nation)) WHERE amount > 5"
)
def filter_stages(spark, sf_dir):
    """Filters before linking, on what a link brought in, and on what unnesting made."""
    nation = {"source": "raw_nation", "public_id": "nation_id", "keys": ["n_nationkey"], "columns": ["n_name"]}
    customer = {
        "source": "raw_customer", "keys": ["c_custkey"], "columns": ["c_custkey", "parity", "balance", "nation"],
        "filters": [{"type": "query", "query": "parity == 0"}, {"type": "query", "query": "n_name > 'E'", "stage": "after_link"}, {"type": "query", "query": "amount > 5", "stage": "after_unnest"}],
        "foreign_keys": [{"entity": "nation", "local_keys": ["nation"], "remote_keys": ["n_nationkey"], "extra_columns": {"n_name": "n_name"}}],
        "unnest": {"id_vars": ["c_custkey", "n_name"], "value_vars": ["balance", "nation"], "var_name": "measure", "value_name": "amount"},
    }
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 2).alias("parity"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    made = normalize(spark, Project.of({"entities": {"nation": nation, "customer": customer}}), ["customer"], {"raw_nation": table(spark, sf_dir, "nation"), "raw_customer": c})
    return made.tables["customer"].select("c_custkey", "n_name", "measure", F.col("amount").cast("double").alias("amount"))


@query(
    "SELECT 'NON_UNIQUE_KEYS' AS code, 'talk' AS entity WHERE (SELECT count(*) > count(DISTINCT conv_id) FROM conversations) UNION ALL SELECT 'COLUMN_NOT_FOUND', 'talk' UNION ALL SELECT 'FK_LOCAL_COLUMN_MISSING', 'talk'"
    " UNION ALL SELECT 'FK_TYPE_MISMATCH', 'label' UNION ALL SELECT 'FK_DATA_INTEGRITY', 'label' WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en'))"
    " UNION ALL SELECT 'EMPTY_RESULT', 'none'"
)
def data_checks(spark, sf_dir):
    """Codes of all data checks over a project with a fault of each kind."""
    spec = {
        "talk": {"source": "x", "keys": ["conv_id"], "columns": ["role", "mood"], "foreign_keys": [{"entity": "doc", "local_keys": ["nowhere"], "remote_keys": ["doc_id"]}]},
        "label": {"source": "x", "keys": ["doc_id"], "foreign_keys": [{"entity": "doc", "local_keys": ["doc_id"], "remote_keys": ["doc_id"]}, {"entity": "doc", "local_keys": ["doc_id"], "remote_keys": ["lang"]}]},
        "doc": {"source": "x", "keys": ["doc_id"], "columns": ["lang"]},
        "none": {"source": "x", "columns": ["doc_id"]},
    }
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    tables = {"talk": table(spark, sf_dir, "conversations").select("conv_id", "role"), "label": table(spark, sf_dir, "labels").select("doc_id"), "doc": docs.where("lang = 'en'"), "none": docs.where("false").select("doc_id")}
    return spark.createDataFrame([(i.code, i.entity) for i in validate(Project.of({"entities": spec}), tables)], "code string, entity string")


# duplicates, dependencies


@query("SELECT conv_id, count(*) AS n_rows FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def non_unique_keys(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "conversations"), ["conv_id"])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_all(spark, sf_dir):
    return drop_duplicates(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), True)


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_keep_first(spark, sf_dir):
    return drop_duplicates(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS n_variants FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def fd_violation_keys(spark, sf_dir):
    return fd_violations(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), ["l_orderkey"])


# reshape


@query(
    "SELECT l_orderkey, l_linenumber, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)"
    " UNPIVOT INCLUDE NULLS (amount FOR measure IN (quantity, discount, tax))"
)
def unnest_measures(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return unnest(df, Unnest(("l_orderkey", "l_linenumber"), ("quantity", "discount", "tax"), "measure", "amount"))


def _people(spark, sf_dir) -> Project:
    return Project.of(
        {
            "entities": {
                "by_name": {"source": "c", "keys": ["code"], "columns": ["code", "name"], "append": [{"source": "s", "columns": ["code", "name", "balance"]}]},
                "by_position": {"source": "c", "keys": ["code"], "columns": ["code", "name"], "append": [{"source": "t", "columns": ["s_suppkey", "s_name"], "keys": [], "align_by_position": True}]},
                "mapped": {"source": "c", "keys": ["code"], "columns": ["code", "name"], "append": [{"source": "t", "columns": ["code", "name"], "column_mapping": {"s_suppkey": "code", "s_name": "name"}}]},
                "party": {"type": "merged", "public_id": "party_id", "columns": ["name"], "branches": [{"name": "buyer", "source": "buyer"}, {"name": "seller", "source": "seller"}]},
                "buyer": {"source": "c", "public_id": "buyer_id", "keys": ["code"], "columns": ["name"]},
                "seller": {"source": "s", "public_id": "seller_id", "keys": ["code"], "columns": ["name"]},
            }
        }
    )


def _built(spark, sf_dir, name: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    given = {"c": c, "s": t.toDF("code", "name", "balance"), "t": t.select("s_suppkey", "s_name")}
    return normalize(spark, _people(spark, sf_dir), [name], given).tables[name]


@query("SELECT c_custkey AS code, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def append_by_name(spark, sf_dir):
    return _built(spark, sf_dir, "by_name").select("code", "name", "balance")


@query("SELECT c_custkey AS code, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_by_position(spark, sf_dir):
    return _built(spark, sf_dir, "by_position").select("code", "name")


@query("SELECT c_custkey AS code, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def append_mapped(spark, sf_dir):
    return _built(spark, sf_dir, "mapped").select("code", "name")


@query(
    "SELECT 'buyer' AS party_branch, c_name AS name, row_number() OVER (ORDER BY c_custkey) AS buyer_id, NULL::BIGINT AS seller_id FROM customer"
    " UNION ALL SELECT 'seller', s_name, NULL, row_number() OVER (ORDER BY s_suppkey) FROM supplier"
)
def merged_branches(spark, sf_dir):
    return _built(spark, sf_dir, "party").select("party_branch", "name", "buyer_id", "seller_id")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS system_id, o_orderkey FROM orders")
def system_ids(spark, sf_dir):
    return add_system_id(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "WITH x AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)), y AS (SELECT CASE WHEN quality IS NOT NULL THEN doc_id + 1 END AS system_id, doc_id FROM x)"
    " SELECT coalesce(system_id, (SELECT max(system_id) FROM y) + sum(CASE WHEN system_id IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY doc_id)) AS system_id, doc_id FROM y"
)
def system_id_fill(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return add_system_id(x.select(F.when(F.col("quality").isNotNull(), F.col("doc_id") + 1).alias("system_id"), "doc_id"), ["doc_id"])


# replacements


def _replaced(base: str, key: str, column: str, spec, order=()):
    def run(spark, sf_dir):
        return apply_replacements(table(spark, sf_dir, base).select(key, column), {column: spec}, order).select(key, F.col(column).alias("r"))

    return run


_REPLACED = {
    "replace_map": ("orders", "o_orderkey", "o_orderstatus", {"F": "O", "O": "F"}, "CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END"),
    "replace_equals": ("orders", "o_orderkey", "o_orderpriority", [{"from": " 1-urgent", "to": "now", "normalize": ["strip", "lower"]}], "CASE WHEN lower(trim(o_orderpriority)) = '1-urgent' THEN 'now' ELSE o_orderpriority END"),
    "replace_not_in": ("orders", "o_orderkey", "o_orderstatus", [{"match": "not_in", "from": ["F", "O"], "to": "other"}], "CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'other' ELSE o_orderstatus END"),
    "replace_contains": ("part", "p_partkey", "p_type", [{"match": "contains", "from": "steel", "flags": ["ignorecase"], "to": "metal"}], "CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' ELSE p_type END"),
    "replace_startswith": ("part", "p_partkey", "p_brand", [{"match": "startswith", "from": "Brand#1", "to": None}], "CASE WHEN NOT starts_with(p_brand, 'Brand#1') THEN p_brand END"),
    "replace_endswith": ("part", "p_partkey", "p_brand", [{"match": "not_endswith", "from": "2", "to": "x"}], "CASE WHEN NOT ends_with(p_brand, '2') THEN 'x' ELSE p_brand END"),
    "replace_regex": ("part", "p_partkey", "p_brand", [{"match": "regex", "from": r"Brand#[1-3]\d", "to": "low"}], r"CASE WHEN regexp_matches(p_brand, '^Brand#[1-3]\d') THEN 'low' ELSE p_brand END"),
    "replace_regex_sub": ("part", "p_partkey", "p_brand", [{"match": "regex_sub", "from": r"Brand#(\d)(\d)", "to": r"\2-\1"}], r"regexp_replace(p_brand, 'Brand#(\d)(\d)', '\2-\1', 'g')"),
    "replace_transform": ("customer", "c_custkey", "c_mktsegment", [{"normalize": ["strip", "lower", "collapse_ws"]}], "lower(trim(c_mktsegment))"),
    "replace_coerce": ("part", "p_partkey", "p_retailprice", [{"coerce": "int"}], "CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END"),
}
for _name, (_base, _key, _column, _spec, _sql) in _REPLACED.items():
    QUERIES[_name] = _replaced(_base, _key, _column, _spec)
    ORACLES[_name] = f"SELECT {_key}, {_sql} AS r FROM {_base}"

_BLANK = "SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS v FROM events"
QUERIES["blank_out_forward"] = _replaced("events", "event_id", "event_type", "click", ("event_id",))
ORACLES["blank_out_forward"] = f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS r FROM ({_BLANK})"
QUERIES["blank_out_backward"] = _replaced("events", "event_id", "event_type", [{"blank_out": ["click"], "fill": "backward"}], ("event_id",))
ORACLES["blank_out_backward"] = f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM ({_BLANK})"
QUERIES["blank_out_constant"] = _replaced("events", "event_id", "event_type", [{"blank_out": ["click"], "fill": {"constant": "none"}}])
ORACLES["blank_out_constant"] = f"SELECT event_id, coalesce(v, 'none') AS r FROM ({_BLANK})"


@query(
    "SELECT o_orderkey, CASE lower(trim(o_orderpriority)) WHEN '1-urgent' THEN 'now' WHEN '5-low' THEN 'later' ELSE o_orderpriority END AS o_orderpriority,"
    " CASE o_custkey % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CAST(o_custkey % 4 AS VARCHAR) || '.0' END AS kind FROM orders"
)
def replace_map_shaped(spark, sf_dir):
    """Maps whose keys are compared after normalising, and after coercing (the text 1.0 is the number 1)."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.concat((F.col("o_custkey") % 4).cast("string"), F.lit(".0")).alias("kind"))
    return apply_replacements(df, {"o_orderpriority": [{"map": {" 1-Urgent": "now", "5-LOW": "later"}, "normalize": ["strip", "lower"]}], "kind": [{"map": {"1": "one", 2: "two"}, "coerce": "int"}]})


@query(
    "SELECT 'o_orderstatus' AS column, 0 AS rule, 'map' AS kind, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS replaced"
    " UNION ALL SELECT 'o_orderpriority', 0, 'startswith', (SELECT count(*) FROM orders WHERE starts_with(o_orderpriority, '1'))"
    " UNION ALL SELECT 'o_orderpriority', 1, 'equals', (SELECT count(*) FROM orders WHERE starts_with(o_orderpriority, '1') OR o_orderpriority = '5-LOW')"
)
def replaced_cells(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    rules = [{"match": "startswith", "from": "1", "to": "5-LOW"}, {"match": "equals", "from": "5-LOW", "to": None}]
    return replaced_counts(df, {"o_orderstatus": {"F": "done"}, "o_orderpriority": rules})


@query("SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY k DESC NULLS FIRST, event_id DESC) AS r FROM (SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS v, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) END AS k FROM events)")
def blank_out_backward_by_text(spark, sf_dir):
    """Backward in the order of a text key, nulls last."""
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("k"), "event_type")
    return apply_replacements(df, {"event_type": [{"blank_out": ["click"], "fill": "backward"}]}, ("k", "event_id")).select("event_id", F.col("event_type").alias("r"))


@query("SELECT p_brand AS value, count(*) AS count FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_unmatched(spark, sf_dir):
    """The report's top 5: the limit is the feature."""
    return unmatched(table(spark, sf_dir, "part"), "p_brand", {"Brand#11": "a", "Brand#12": "b"}, 5)


# sinks, ingest, reconciliation, services


@query(
    "SELECT 'customer' AS entity, count(*) AS num_rows, 5 AS num_columns FROM customer UNION ALL SELECT 'nation', count(*), 3 FROM nation UNION ALL SELECT 'orders', count(*), 6 FROM orders"
)
def shapes_report(spark, sf_dir):
    return table_shapes(spark, {n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders")})


def _submission(spark, sf_dir) -> eav.Submission:
    columns = [
        {"table_name": "tbl_suppliers", "column_name": "supplier_id", "data_type": "bigint", "is_pk": True, "class_name": "java.lang.Long", "position": 0},
        {"table_name": "tbl_suppliers", "column_name": "s_name", "class_name": "java.lang.String", "position": 1},
        {"table_name": "tbl_suppliers", "column_name": "nation_id", "data_type": "bigint", "is_fk": True, "fk_table_name": "tbl_nations", "class_name": "com.x.Nation", "position": 2},
        {"table_name": "tbl_nations", "column_name": "nation_id", "data_type": "bigint", "is_pk": True, "class_name": "java.lang.Long", "position": 0},
        {"table_name": "tbl_nations", "column_name": "n_name", "class_name": "java.lang.String", "position": 1},
    ]
    schema = eav.Schema.of([{"table_name": "tbl_suppliers", "pk_name": "supplier_id", "java_class": "Supplier"}, {"table_name": "tbl_nations", "pk_name": "nation_id", "java_class": "Nation", "is_lookup": True}], columns)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("system_id"), F.lit(None).cast("long").alias("supplier_id"), "s_name", F.col("s_nationkey").alias("nation_id"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("system_id"), (F.col("n_nationkey") + 100).alias("nation_id"), "n_name")
    return eav.Submission(schema, {"tbl_suppliers": supplier, "tbl_nations": nation})


@query(
    "WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS system_id, s_name, s_nationkey FROM supplier)"
    " SELECT system_id, 'supplierId' AS column_name, 'NULL' AS fk_system_id, 'NULL' AS fk_public_id, '' AS column_value FROM s"
    " UNION ALL SELECT system_id, 'sName', 'NULL', 'NULL', '\"' || s_name || '\"' FROM s"
    " UNION ALL SELECT system_id, 'nationId', CAST(s_nationkey AS VARCHAR), CAST(n_nationkey + 100 AS VARCHAR), 'NULL' FROM s LEFT JOIN nation ON s_nationkey = n_nationkey"
    " UNION ALL SELECT system_id, 'clonedId', 'NULL', 'NULL', 'NULL' FROM s"
)
def eav_export(spark, sf_dir):
    return eav.export_eav(spark, _submission(spark, sf_dir)).recordvalues.select("system_id", "column_name", "fk_system_id", "fk_public_id", "column_value")


@query(
    "SELECT s_suppkey AS system_id, CAST(NULL AS BIGINT) AS supplier_id, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_nationkey END AS nation_id, 'tbl_suppliers' AS table_name FROM supplier"
    " UNION ALL SELECT DISTINCT n, n, NULL, n, 'tbl_nations' FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_nationkey END AS n FROM supplier)"
)
def ingest_policies(spark, sf_dir):
    """A missing primary key column, a default foreign key, a missing table that becomes its referenced keys, integer widths, system ids."""
    s = _submission(spark, sf_dir)
    nation = F.when(F.col("system_id") % 3 != 0, F.col("nation_id")).cast("string")
    s.tables = {"tbl_suppliers": s.tables["tbl_suppliers"].drop("supplier_id").withColumn("nation_id", nation)}
    s = eav.apply_policies(s, {"update_missing_foreign_key": {"tbl_suppliers": {"nation_id": 7}}})
    own = s.tables["tbl_suppliers"].select("system_id", "supplier_id", "s_name", "nation_id", F.lit("tbl_suppliers").alias("table_name"))
    return own.unionByName(s.tables["tbl_nations"].select("system_id", F.col("nation_id").alias("supplier_id"), F.lit(None).cast("string").alias("s_name"), "nation_id", F.lit("tbl_nations").alias("table_name")))


@query("SELECT DISTINCT s_nationkey AS key FROM supplier WHERE s_nationkey IS NOT NULL")
def referenced_keys(spark, sf_dir):
    return eav.referenced_keys(_submission(spark, sf_dir), "tbl_nations")


@query("SELECT DISTINCT o_custkey AS system_id, o_custkey AS customer_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def missing_lookup_rows(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("key")).distinct()
    return eav.missing_lookup_rows(table(spark, sf_dir, "customer").where("c_nationkey != 3").select(F.col("c_custkey").alias("system_id")), keys, "customer_id")


@query(
    "SELECT p_name AS source_value, CASE WHEN score >= 70 THEN p_partkey END AS target_id, score / 100 AS confidence, CASE WHEN score >= 95 THEN 'accepted' WHEN score >= 70 THEN 'review' ELSE 'unmatched' END AS status"
    " FROM (SELECT p_name, p_partkey, CAST(p_size * 2 AS DOUBLE) AS score FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, 'http://x/' || p_partkey) = 1)"
)
def reconcile_classify(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = part.select(F.col("p_name").alias("query"), F.concat(F.lit("http://x/"), "p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 2.0).alias("score"))
    return reconcile.classify(part.select(F.col("p_name").alias("query")), found).select("source_value", "target_id", "confidence", "status")


@query("SELECT c_custkey, round(c_acctbal, 2) AS pos_lat, CAST(c_nationkey AS DOUBLE) AS pos_lon FROM customer")
def geo_split(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.round("c_acctbal", 2).cast("string"), F.lit(", "), F.col("c_nationkey").cast("string")).alias("pos"))
    return geo.geo_split(df, "pos").select("c_custkey", "pos_lat", "pos_lon")


@query(
    "SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN radians(CAST(c_nationkey AS DOUBLE)) * 6378137.0 WHEN 1 THEN CAST(c_nationkey AS DOUBLE) END, 3) AS x,"
    " round(CASE c_custkey % 3 WHEN 0 THEN ln(tan(radians(c_custkey % 80) / 2 + pi() / 4)) * 6378137.0 WHEN 1 THEN CAST(c_custkey % 80 AS DOUBLE) END, 3) AS y FROM customer"
)
def geo_convert_by_column(spark, sf_dir):
    """Each row's own system, as a number or as text with a prefix; a row without one has no coordinates."""
    code = F.when(F.col("c_custkey") % 3 == 0, "EPSG:4326").when(F.col("c_custkey") % 3 == 1, "3857")
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 80).cast("double").alias("y"), code.alias("crs"))
    return geo.convert_crs(df, "x", "y", "crs", 3857, source_column=True).select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(
    "SELECT c_custkey, round(radians(CAST(c_nationkey AS DOUBLE)) * 6378137.0, 3) AS x, round(ln(tan(radians(c_custkey % 80) / 2 + pi() / 4)) * 6378137.0, 3) AS y FROM customer"
)
def geo_convert_crs(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("x"), (F.col("c_custkey") % 80).cast("double").alias("y"))
    return geo.convert_crs(df, "x", "y", 4326, 3857).select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


#: conic and transverse Mercator formulas over GRS 80, from the isometric latitude psi
_GRS80 = "WITH g AS (SELECT 6378137.0 AS a, 1 / 298.257222101 AS f), k AS (SELECT a, sqrt(f * (2 - f)) AS e, f / (2 - f) AS n FROM g)"


@query(
    _GRS80 + ", m AS (SELECT *, cos(radians(49)) / sqrt(1 - (e * sin(radians(49))) ** 2) AS m1, cos(radians(44)) / sqrt(1 - (e * sin(radians(44))) ** 2) AS m2,"
    " atanh(sin(radians(49))) - e * atanh(e * sin(radians(49))) AS p1, atanh(sin(radians(44))) - e * atanh(e * sin(radians(44))) AS p2,"
    " atanh(sin(radians(46.5))) - e * atanh(e * sin(radians(46.5))) AS p0 FROM k),"
    " c AS (SELECT e, ln(m1 / m2) / (p2 - p1) AS w, a * m1 * exp(ln(m1 / m2) / (p2 - p1) * p1) / (ln(m1 / m2) / (p2 - p1)) AS s, p0 FROM m),"
    " q AS (SELECT c_custkey, radians(-4 + c_custkey % 120 / 10.0) AS lon, radians(42 + c_nationkey * 0.35) AS lat FROM customer),"
    " r AS (SELECT c_custkey, w * (lon - radians(3)) AS d, s * exp(-w * (atanh(sin(lat)) - e * atanh(e * sin(lat)))) AS rho, s * exp(-w * p0) AS rho0 FROM q, c)"
    " SELECT c_custkey, round(700000 + rho * sin(d), 2) AS x, round(6600000 + rho0 - rho * cos(d), 2) AS y FROM r"
)
def geo_convert_table(spark, sf_dir):
    """A whole table from longitude and latitude to a conic with two parallels."""
    df = table(spark, sf_dir, "customer").select("c_custkey", (-4 + F.col("c_custkey") % 120 / 10.0).alias("x"), (42 + F.col("c_nationkey") * 0.35).alias("y"))
    return geo.convert_crs(df, "x", "y", 4258, 2154).select("c_custkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query(
    _GRS80 + ", z(code, lat0, lon0, scale, x0, y0) AS (VALUES (0, 0, 15, 0.9996, 500000, 0), (1, 0, 18, 1.0, 150000, 0), (2, 53.5, -8, 0.99982, 600000, 750000), (3, 0, 173, 0.9996, 1600000, 10000000)),"
    " b AS (SELECT z.*, k.*, scale * a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS size, asin(tanh(atanh(sin(radians(lat0))) - e * atanh(e * sin(radians(lat0))))) AS w FROM z, k),"
    " o AS (SELECT *, y0 - size * (w + (n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180) * sin(2 * w) + (13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440) * sin(4 * w)"
    " + (61 * n ** 3 / 240 - 103 * n ** 4 / 140) * sin(6 * w) + 49561 * n ** 4 / 161280 * sin(8 * w)) AS y1 FROM b),"
    " p AS (SELECT c_custkey, o.*, ((c_nationkey * 9000.0 + 50000) - x0) / size AS u, ((c_custkey % 500) * 900.0 + CASE c_custkey % 4 WHEN 3 THEN 5200000 WHEN 2 THEN 600000 ELSE 6200000 END - y1) / size AS v"
    " FROM customer JOIN o ON code = c_custkey % 4),"
    " h AS (SELECT *, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 - n ** 4 / 360 AS b1, n ** 2 / 48 + n ** 3 / 15 - 437 * n ** 4 / 1440 AS b2, 17 * n ** 3 / 480 - 37 * n ** 4 / 840 AS b3, 4397 * n ** 4 / 161280 AS b4 FROM p),"
    " s AS (SELECT *, v - b1 * sin(2 * v) * cosh(2 * u) - b2 * sin(4 * v) * cosh(4 * u) - b3 * sin(6 * v) * cosh(6 * u) - b4 * sin(8 * v) * cosh(8 * u) AS xi,"
    " u - b1 * cos(2 * v) * sinh(2 * u) - b2 * cos(4 * v) * sinh(4 * u) - b3 * cos(6 * v) * sinh(6 * u) - b4 * cos(8 * v) * sinh(8 * u) AS eta FROM h),"
    " t AS (SELECT *, asin(sin(xi) / cosh(eta)) AS chi FROM s)"
    " SELECT c_custkey, round(lon0 + degrees(atan2(sinh(eta), cos(xi))), 7) AS lon, round(degrees(chi + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3 + 116 * n ** 4 / 45) * sin(2 * chi)"
    " + (7 * n ** 2 / 3 - 8 * n ** 3 / 5 - 227 * n ** 4 / 45) * sin(4 * chi) + (56 * n ** 3 / 15 - 136 * n ** 4 / 35) * sin(6 * chi) + 4279 * n ** 4 / 630 * sin(8 * chi)), 7) AS lat FROM t"
)
def geo_convert_projected(spark, sf_dir):
    """Rows in four national systems, each named in its row, to longitude and latitude."""
    which = F.col("c_custkey") % 4
    code = F.when(which == 0, "EPSG:3006").when(which == 1, "3011").when(which == 2, "epsg:2157").otherwise("2193")
    north = (F.col("c_custkey") % 500) * 900.0 + F.when(which == 3, 5200000).when(which == 2, 600000).otherwise(6200000)
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 9000.0 + 50000).alias("x"), north.alias("y"), code.alias("crs"))
    out = geo.convert_crs(df, "x", "y", "crs", 4258, source_column=True, names=("lon", "lat"))
    return out.select("c_custkey", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS system_id, o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def preview_limit(spark, sf_dir):
    """A preview of 50 rows: the limit is the feature."""
    project = Project.of({"entities": {"order": {"source": "raw", "keys": ["o_orderkey"], "columns": ["o_custkey", "o_totalprice"]}}})
    return analysis.Previews(spark).preview(project, "order", 50, given={"raw": table(spark, sf_dir, "orders")}).select("system_id", "o_orderkey", "o_custkey", "o_totalprice")


@query(
    "SELECT n_name, count(*) AS n_orders, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_filled FROM orders, customer, nation"
    " WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 0"
)
def adhoc_sql(spark, sf_dir):
    """A user's statement, checked first, over the tables of a project that were built and registered as views."""
    sources = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "customer": ["c_custkey", "c_nationkey"], "nation": ["n_nationkey", "n_name"]}
    project = Project.of({"entities": {f"my_{n}": {"source": n, "keys": c[:1], "columns": c[1:]} for n, c in sources.items()}})
    normalize(spark, project, None, {n: table(spark, sf_dir, n) for n in sources}).views()
    mine = (
        "WITH located AS (SELECT c_custkey, n_name FROM my_customer JOIN my_nation ON c_nationkey = n_nationkey)"
        " SELECT n_name, count(*) AS n_orders, count_if(o_orderstatus = 'F') AS n_filled FROM my_orders JOIN located ON o_custkey = c_custkey GROUP BY n_name"
    )
    checked = analysis.check_query(spark, mine)
    if not checked["is_valid"]:
        raise ValueError(checked["errors"])
    return spark.sql(mine)


@query(
    "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n_rows FROM events GROUP BY ALL"
)
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"])


@query("SELECT event_id, ts, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1")
def stream_first_rows(spark, sf_dir):
    """Each user's first event of a type; a stream gives the same rows once its watermark has passed them."""
    return stateful.keep_first(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), ["user_id", "event_type"], "ts")


@query(
    "SELECT event_id, ts, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS value, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS props"
    " FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS v, CASE WHEN event_type = 'click' THEN props END AS p FROM events)"
)
def stream_forward_fill(spark, sf_dir):
    """Gaps of two columns filled from the user's events before, as a stream does it."""
    gaps = {"value": F.when(F.col("event_id") % 3 != 0, F.col("value")), "props": F.when(F.col("event_type") == "click", F.col("props"))}
    df = table(spark, sf_dir, "events").withColumns(gaps).select("event_id", "ts", "user_id", "value", "props")
    return stateful.forward_fill(df, ["user_id"], ["value", "props"], "ts")


@query(
    "WITH a AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY o_custkey) AS system_id FROM (SELECT DISTINCT o_custkey FROM orders)),"
    " b AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) + (SELECT count(*) FROM a) AS system_id FROM customer WHERE c_custkey NOT IN (SELECT k FROM a))"
    " SELECT c_custkey AS k, coalesce(a.system_id, b.system_id) AS system_id FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey"
)
def ledger_ids(spark, sf_dir):
    """Ids given to the customers of orders in one batch, kept in the next, where the other customers get the numbers after them."""
    ledger = f"{shared_folder(spark)}/tessera-ledger-{uuid.uuid4().hex}"
    stateful.with_ids(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("k")), 0, ["k"], ledger)
    return stateful.with_ids(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")), 1, ["k"], ledger)


def _mounted(spark: SparkSession, name: str) -> str:
    """A new file in the shared folder, which must be mounted: a workbook or database file has a path."""
    folder = shared_folder(spark).removeprefix("file://")
    if "://" in folder:
        raise ValueError(f"{folder} is no mounted folder")
    return f"{folder}/{uuid.uuid4().hex}-{name}"


@query(
    "SELECT p_brand AS brand, p_type AS kind, count(*) AS n, min(p_size) AS least, max(p_retailprice) AS dearest, bool_or(p_size > 45) AS large, CASE WHEN count(*) % 3 > 0 THEN p_brand || ' & ' || p_type END AS note"
    " FROM part GROUP BY p_brand, p_type"
)
def workbook_round_trip(spark, sf_dir):
    """Figures of all parts, written to a workbook by tasks and read from it by tasks; types come from the cells."""
    note = F.when(F.count(F.lit(1)) % 3 > 0, F.concat_ws(" & ", F.col("p_brand"), F.col("p_type")))
    figures = [F.count(F.lit(1)).alias("n"), F.min("p_size").alias("least"), F.max("p_retailprice").alias("dearest"), F.bool_or(F.col("p_size") > 45).alias("large"), note.alias("note")]
    made = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(*figures)
    path = _mounted(spark, "parts.xlsx")
    write("xlsx", path, {"parts": made})
    return read_workbook(spark, Entity.of("parts", {"type": "xlsx", "source": "parts"}), {"filename": path})


@query(
    "SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1 HAVING count(*) > 1"
)
def sqlite_round_trip(spark, sf_dir):
    """Figures of all orders by day, written to a database and read by a query that is cut at its key into equal parts."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    made = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), cents)
    path = _mounted(spark, "orders.db")
    write("db", path, {"days": made})
    entity = Entity.of("days", {"type": "sqlite", "query": "SELECT day, n, cents FROM days WHERE n > 1", "keys": ["day"], "columns": ["n", "cents"]})
    return read_sqlite(spark, entity, {"filename": path, "numPartitions": 4})


@query("SELECT DISTINCT value FROM (SELECT c_mktsegment AS value FROM customer UNION ALL SELECT o_orderpriority FROM orders)")
def union_distinct(spark, sf_dir):
    """append_mode: distinct of an entity."""
    project = Project.of({"entities": {"value": {"source": "c", "keys": ["value"], "columns": ["value"], "append_mode": "distinct", "append": [{"source": "o", "columns": ["value"]}]}}})
    given = {"c": table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value")), "o": table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value"))}
    return normalize(spark, project, ["value"], given).tables["value"].select("value")


# a whole project


def customers_project() -> Project:
    """Regions, nations and customers linked by surrogate ids, with derived columns, a filter and constraints."""
    return Project.of(
        {
            "metadata": {"name": "customers"},
            "entities": {
                "region": {"source": "raw_region", "public_id": "region_id", "keys": ["r_regionkey"], "columns": ["r_name"]},
                "nation": {
                    "source": "raw_nation", "public_id": "nation_id", "keys": ["n_nationkey"], "columns": ["n_name", "n_regionkey"],
                    "foreign_keys": [{"entity": "region", "local_keys": ["n_regionkey"], "remote_keys": ["r_regionkey"], "how": "left", "extra_columns": {"region_name": "r_name"}, "constraints": {"cardinality": "many_to_one"}}],
                },
                "customer": {
                    "source": "raw_customer", "public_id": "customer_id", "keys": ["c_custkey"], "columns": ["c_name", "c_mktsegment", "c_nationkey"],
                    "replacements": {"c_mktsegment": {"BUILDING": "CONSTRUCTION"}},
                    "filters": [{"type": "query", "query": "c_nationkey >= 0"}],
                    "foreign_keys": [{"entity": "nation", "local_keys": ["c_nationkey"], "remote_keys": ["n_nationkey"], "how": "left", "extra_columns": ["n_name", "region_name"], "constraints": {"cardinality": "many_to_one", "allow_unmatched_left": False}}],
                    "extra_columns": {"label": "=concat(upper(n_name), '/', c_mktsegment)", "title": "{region_name}: {c_name}"},
                },
            },
        }
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {f"raw_{n}": table(spark, sf_dir, n) for n in ("region", "nation", "customer")}
    return normalize(spark, customers_project(), ["customer"], given).tables["customer"]


@query(
    "SELECT row_number() OVER (ORDER BY c_custkey) AS system_id, NULL::BIGINT AS customer_id, nation_id, upper(n_name) || '/' || s AS label, r_name || ': ' || c_name AS title, c_custkey, s AS c_mktsegment, c_name, c_nationkey, n_name, r_name AS region_name"
    " FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS s FROM customer WHERE c_nationkey >= 0)"
    " JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) AS nation_id, * FROM nation) ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
def project_customers(spark, sf_dir):
    return flagship(spark, sf_dir)
