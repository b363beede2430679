"""Registered queries, each with the SQL that checks it where SQL can express it. All read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.operators import encode, grow, metrics, registry, runlog, scenario, score, split, train, validate
from sparkforest.operators.grid import ForestConfig
from sparkforest.operators.scenario import Scenario
from sparkforest.plans.models import score_requests
from sparkforest.plans.training import TrainingRequest, compare_scenarios
from sparkforest.plans.training import train as train_job
from sparkforest.sources import io
from sparkforest.streaming import streams
from sparkforest.streaming.liveness import liveness_transitions

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RID_SQL = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rid():
    """A row id of lineitem from its integer keys."""
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def net():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def u_sql(seed: str, id: str) -> str:
    return f"(concat('0x', substr(md5(concat({seed}, ':', {id})), 1, 8))::UBIGINT / 4294967296.0)"


def labelled(spark, sf_dir: str) -> DataFrame:
    """lineitem with a target that its columns decide: whether the net price is over 50000."""
    return table(spark, sf_dir, "lineitem").withColumn("row_id", rid()).withColumn("is_large", (net() > 50000).cast("int"))


#: A stand-in model: label and a rule's prediction.
RULE_SQL = "select case when l_extendedprice * (1 - l_discount) > 50000 then 'large' when l_extendedprice * (1 - l_discount) > 20000 then 'middle' else 'small' end as label, case when l_quantity > 30 then 'large' when l_quantity > 12 then 'middle' else 'small' end as prediction, * from lineitem"


def ruled(spark, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("label", F.when(net() > 50000, "large").when(net() > 20000, "middle").otherwise("small")).withColumn("prediction", F.when(q > 30, "large").when(q > 12, "middle").otherwise("small"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario, encoding, split, forest, hard vote, accuracy by split."""
    df, _ = scenario.apply_scenario(labelled(spark, sf_dir).select("row_id", "is_large", *FEATURES, "l_linestatus"), "is_large", Scenario(drop=("l_tax",)))
    vocab = encode.fit_vocab(df, ["l_linestatus"])
    ready = split.assign_splits(encode.one_hot(df, vocab, "is_large"), validation_ratio=0.2, test_ratio=0.2, seed=42, row_id="row_id")
    names = [c for c in ready.columns if c not in ("row_id", "is_large", "split")]
    ready = train.stored(scenario.to_double(ready, names))
    nodes = train.fit_forest_ml(ready.where("split = 'train'"), names, "is_large", ForestConfig(4, 5))
    scored = score.predict(ready, nodes, names, ["0", "1"]).withColumn("right", (F.col("prediction") == F.col("is_large").cast("string")).cast("double"))
    return scored.groupBy("split").agg(F.count("*").alias("n"), F.avg("right").alias("accuracy"))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate from lineitem")
def scenario_drop(spark, sf_dir):
    return scenario.apply_scenario(table(spark, sf_dir, "lineitem"), "l_returnflag", Scenario(drop=("l_tax", "l_discount", "absent", "l_returnflag")))[0]


@query("select l_linestatus, l_quantity, l_returnflag from lineitem")
def scenario_keep(spark, sf_dir):
    return scenario.apply_scenario(table(spark, sf_dir, "lineitem"), "l_returnflag", Scenario(keep=("l_linestatus", "absent", "l_quantity", "l_returnflag")))[0]


@query("select 'custom' as scenario, count(*) as rows_before, count(*) as rows_after, 11 as columns_before, 9 as columns_after, 'l_tax,l_discount' as dropped, 'absent' as missing from lineitem")
def scenario_report(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    report = scenario.scenario_report(df, scenario.apply_scenario(df, "l_returnflag", Scenario(drop=("l_tax", "l_discount", "absent")))[1])
    return report.select("scenario", "rows_before", "rows_after", "columns_before", "columns_after", F.array_join("dropped_columns", ",").alias("dropped"), F.array_join("missing_columns", ",").alias("missing"))


@query("select doc_id, case when source = lang then source else source || '|' || lang end as names from documents")
def leakage_list_parse(spark, sf_dir):
    text = F.concat(F.lit(" "), "source", F.lit(", ,"), "lang", F.lit(" ,"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(scenario.parse_column_list(text), "|").alias("names"))


@query(f"""select {RID_SQL} as row_id, l_quantity, {', '.join(f"case when l_returnflag = '{v}' then 1.0::double else 0.0::double end as l_returnflag_{v}" for v in "ANR")}, 0.0::double as l_returnflag_nan, {', '.join(f"case when l_linestatus = '{v}' then 1.0::double else 0.0::double end as l_linestatus_{v}" for v in "FO")}, 0.0::double as l_linestatus_nan, l_tax from lineitem""")
def onehot_encode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(rid().alias("row_id"), "l_quantity", "l_returnflag", "l_linestatus", "l_tax")
    return encode.one_hot(df, encode.fit_vocab(df, ["l_returnflag", "l_linestatus"]), "l_tax")


@query("select doc_id, " + ", ".join(f"case when doc_id % 7 <> 0 and lang = '{v}' then 1.0::double else 0.0::double end as lang_{v}" for v in ("de", "en", "es", "fr")) + ", case when doc_id % 7 = 0 then 1.0::double else 0.0::double end as lang_nan from documents")
def onehot_null_indicator(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    return encode.one_hot(df, encode.fit_vocab(df, ["lang"]))


@query("select label, cast(row_number() over (order by label) - 1 as int) as idx from (select distinct o_orderpriority as label from orders)")
def label_mapping(spark, sf_dir):
    return encode.label_index(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("select bool_and(label >= 0 and label < 10) as integer_encoded from embeddings")
def integer_label_check(spark, sf_dir):
    return validate.is_integer_encoded(table(spark, sf_dir, "embeddings"), "label", 10)


@query("select count(distinct o_orderstatus) as n_classes, count(distinct o_orderstatus) >= 2 as ok from orders")
def class_check(spark, sf_dir):
    return validate.class_check(table(spark, sf_dir, "orders"), "o_orderstatus")


_HASH_SQL = f"select o_orderkey, case when u < 0.2 then 'test' when u < 0.4 then 'validation' else 'train' end as split from (select o_orderkey, {u_sql('42', 'o_orderkey')} as u from orders)"


@query(_HASH_SQL)
def split_hash(spark, sf_dir):
    return split.assign_splits(table(spark, sf_dir, "orders"), validation_ratio=0.2, test_ratio=0.2, seed=42, row_id="o_orderkey").select("o_orderkey", "split")


@query(f"select split, count(*) as n from ({_HASH_SQL}) group by split")
def split_sizes(spark, sf_dir):
    return split.split_sizes(split_hash(spark, sf_dir))


@query(f"""with r as (select doc_id, row_number() over (partition by quality order by {u_sql('7', 'doc_id')}, doc_id) as rk, count(*) over (partition by quality) as n from labels),
s as (select *, ceil(n * 0.2 - 1e-9) as nt from r)
select doc_id, case when rk <= nt then 'test' when rk <= nt + ceil((n - nt) * (0.2 / (1 - 0.2)) - 1e-9) then 'validation' else 'train' end as split from s""")
def split_stratified_exact(spark, sf_dir):
    return split.assign_splits(table(spark, sf_dir, "labels"), validation_ratio=0.2, test_ratio=0.2, seed=7, row_id="doc_id", target="quality", task_type="classification", exact=True).select("doc_id", "split")


@query("select count(*) as n_classes, min(n) as smallest, cast(sum(n) as bigint) as n_rows, count(*) >= 2 and min(n) >= 2 and round(sum(n) * 0.2) >= count(*) and sum(n) - round(sum(n) * 0.2) >= count(*) as eligible from (select quality, count(*) as n from labels group by quality)")
def stratify_eligibility(spark, sf_dir):
    return split.stratify_eligibility(table(spark, sf_dir, "labels"), "quality", 0.2)


_DRAWS = " + ".join(f"(case when u >= {p!r} then 1 else 0 end)" for p in split._POISSON)


@query(f"select o_orderkey, tree_index, 42 + tree_index as tree_seed, {_DRAWS} as weight from (select o_orderkey, t.i::int as tree_index, {u_sql('42 + t.i', 'o_orderkey')} as u from orders, range(3) t(i))")
def bootstrap_weights(spark, sf_dir):
    return split.bootstrap_weights(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3, 42)


@query("select t.i::int as tree_index, 42 + t.i::int as tree_seed, count(*)::bigint as drawn, 0::bigint as strangers from orders, range(4) t(i) group by t.i")
def exact_bootstrap_sums(spark, sf_dir):
    """Each tree draws as many rows as there are, all of the table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    drawn = split.exact_bootstrap(orders, "o_orderkey", 4, 42)
    known = drawn.join(orders.distinct().withColumn("known", F.lit(1)), "o_orderkey", "left")
    return known.groupBy("tree_index", "tree_seed").agg(F.sum("weight").cast("long").alias("drawn"), F.count(F.when(F.col("known").isNull(), 1)).alias("strangers"))


@query("select o_orderkey, cast(least((row_number() over (order by o_orderkey) - 1) // greatest(1, (select count(*) from orders) // 7), 6) as int) as shard from orders")
def row_shards(spark, sf_dir):
    return split.shard_rows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)


def binned(spark, sf_dir: str) -> DataFrame:
    cells = F.posexplode(F.array(F.floor(F.col("l_quantity") / 5).cast("int"), F.floor(F.col("l_extendedprice") / 10000).cast("int"), F.round(F.col("l_discount") * 100).cast("int"))).alias("feature", "bin")
    return labelled(spark, sf_dir).withColumn("qty", F.floor("l_quantity")).select(F.lit(0).alias("tree"), F.col("is_large").alias("label"), F.lit(1).alias("weight"), "qty", cells)


_BINS = """with b as (select case when l_extendedprice * (1 - l_discount) > 50000 then 1 else 0 end as y, floor(l_quantity) as qty, unnest([0, 1, 2]) as feature, unnest([cast(floor(l_quantity / 5) as int), cast(floor(l_extendedprice / 10000) as int), cast(round(l_discount * 100) as int)]) as bin from lineitem),
c as (select feature, bin, sum(1 - y)::double as c0, sum(y)::double as c1, count(*)::double as w, sum(qty)::double as s, sum(qty * qty)::double as q from b group by feature, bin),
d as (select feature, bin, sum(c0) over u as l0, sum(c1) over u as l1, sum(w) over u as lw, sum(s) over u as ls, sum(q) over u as lq, sum(c0) over a as a0, sum(c1) over a as a1, sum(w) over a as aw, sum(s) over a as sa, sum(q) over a as qa from c window u as (partition by feature order by bin), a as (partition by feature)),
"""
_BEST = "select 0 as tree, feature, bin, gain, lw as n_left, aw - lw as n_right, aw as n from g where lw >= 1 and aw - lw >= 1 order by gain desc, feature, bin limit 1"


def _class_sql(imp: str) -> str:
    of = lambda a, b, n: imp.format(p=f"({a} / ({n}))", q=f"({b} / ({n}))")
    return _BINS + f"g as (select *, round({of('a0', 'a1', 'aw')} - (lw * {of('l0', 'l1', 'lw')} + (aw - lw) * {of('(a0 - l0)', '(a1 - l1)', 'greatest(aw - lw, 1e-300)')}) / aw, 9) as gain from d) " + _BEST


@query(_class_sql("(1 - {p} * {p} - {q} * {q})"))
def best_root_split_gini(spark, sf_dir):
    return train.best_splits(binned(spark, sf_dir), ["tree"], "gini", 2)


@query(_class_sql("(case when {p} > 0 then -{p} * log2({p}) else 0 end + case when {q} > 0 then -{q} * log2({q}) else 0 end)"))
def best_root_split_entropy(spark, sf_dir):
    return train.best_splits(binned(spark, sf_dir), ["tree"], "entropy", 2)


@query(_BINS + "g as (select *, round((qa / aw - (sa / aw) * (sa / aw)) - (lw * (lq / lw - (ls / lw) * (ls / lw)) + case when aw > lw then (aw - lw) * ((qa - lq) / (aw - lw) - ((sa - ls) / (aw - lw)) * ((sa - ls) / (aw - lw))) else 0 end) / aw, 6) as gain from d where feature > 0) " + _BEST)
def best_root_split_variance(spark, sf_dir):
    rows = binned(spark, sf_dir).where("feature > 0").withColumn("label", F.col("qty"))
    return train.best_splits(rows, ["tree"], "variance").withColumn("gain", F.round("gain", 6))


def _root_sql(values: str, threshold: str) -> str:
    """The best cut of three features over all rows, by trying what lacks a value on both sides; two classes, Gini."""
    gini = lambda a, b: f"(1 - ({a}) / (({a}) + ({b})) * ({a}) / (({a}) + ({b})) - ({b}) / (({a}) + ({b})) * ({b}) / (({a}) + ({b})))"
    return f"""with b as (select case when l_extendedprice * (1 - l_discount) > 50000 then 1 else 0 end as y, unnest([0, 1, 2]) as feature, unnest([{values}]) as value from lineitem),
c as (select feature, value, sum(1 - y)::double as c0, sum(y)::double as c1 from b group by feature, value),
m as (select feature, sum(c0) as a0, sum(c1) as a1, coalesce(sum(c0) filter (value is null), 0) as m0, coalesce(sum(c1) filter (value is null), 0) as m1 from c group by feature),
k as (select c.feature, value, sum(c0) over u as p0, sum(c1) over u as p1, lead(value) over (partition by c.feature order by value) as following from c where value is not null window u as (partition by c.feature order by value)),
d as (select k.*, a0, a1, m0 + m1 > 0 as has_missing, o.go_left, p0 + case when o.go_left then m0 else 0 end as l0, p1 + case when o.go_left then m1 else 0 end as l1 from k join m using (feature) join (values (false), (true)) o(go_left) on (m0 + m1 > 0 or not o.go_left)),
g as (select *, l0 + l1 as n_left, a0 + a1 - l0 - l1 as n_right, a0 + a1 as n from d where l0 + l1 >= 1 and a0 + a1 - l0 - l1 >= 1),
r as (select *, round({gini('a0', 'a1')} - (n_left * {gini('l0', 'l1')} + n_right * {gini('(a0 - l0)', '(a1 - l1)')}) / n, 9) as gain from g)
select 0 as tree, feature, {threshold} as threshold, case when has_missing then go_left else n_left >= n_right end as missing_left, gain, n_left, n_right, n from r order by gain desc, feature, value, go_left limit 1"""


_TWO_CLASSES = grow.Rules("gini", 2, 3, 3, 2, 1, True)


def _root_rows(spark, sf_dir: str, *values) -> DataFrame:
    return labelled(spark, sf_dir).select(F.lit(0).alias("tree"), F.col("is_large").alias("label"), F.lit(1).alias("weight"), F.posexplode(F.array(*values)).alias("feature", "value"))


@query(_root_sql("case when l_extendedprice < 50000 or l_partkey % 5 > 0 then floor(l_quantity / 5) end, case when l_suppkey % 3 > 0 then floor(l_extendedprice / 20000) end, case when l_linenumber % 2 = 0 then round(l_discount * 100) end", "value"))
def root_split_with_missing_values(spark, sf_dir):
    known = F.when((F.col("l_extendedprice") < 50000) | (F.col("l_partkey") % 5 > 0), F.floor(F.col("l_quantity") / 5).cast("double"))
    rows = _root_rows(spark, sf_dir, known, F.when(F.col("l_suppkey") % 3 > 0, F.floor(F.col("l_extendedprice") / 20000).cast("double")), F.when(F.col("l_linenumber") % 2 == 0, F.round(F.col("l_discount") * 100)))
    return grow.splits_of(rows, ["tree"], grow.Rules("gini", 2, 3, 3, 2, 1, False))


@query(_root_sql("l_extendedprice, case when l_partkey % 11 > 0 then l_quantity end, l_discount", "case when following is null then 'infinity'::double when (value + following) / 2 > value and (value + following) / 2 < following then (value + following) / 2 else value end"))
def root_split_over_all_values(spark, sf_dir):
    rows = _root_rows(spark, sf_dir, F.col("l_extendedprice"), F.when(F.col("l_partkey") % 11 > 0, F.col("l_quantity")), F.col("l_discount"))
    return grow.splits_of(rows, ["tree"], _TWO_CLASSES, True, train.stored)


@query("""with m as (select quantile_disc(l_quantity, 0.5) filter (l_partkey % 5 > 0) as q, quantile_disc(l_discount, 0.5) filter (l_suppkey % 3 > 0) as d from lineitem)
select l_orderkey, l_linenumber, case when l_partkey % 5 > 0 then l_quantity else q end as l_quantity, case when l_suppkey % 3 > 0 then l_discount else d end as l_discount, case when l_partkey % 5 > 0 then 0.0::double else 1.0::double end as l_quantity_missing from lineitem, m""")
def median_fill(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")).alias("l_quantity"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_discount")).alias("l_discount"))
    return encode.fill_missing(df, encode.medians(df, ["l_quantity", "l_discount"]), ["l_quantity"])


@query(f"""select t.i::int as tree_index, case when t.i < 3 then 'RESUMED' else 'GROWN' end as how, sum({_DRAWS})::double as drawn
from (select *, {u_sql("42", "o_orderkey")} as part from orders) o, range(8) t(i), lateral (select {u_sql("42 + t.i", "o.o_orderkey")} as u) where part >= 0.4 group by t.i""")
def resumed_trees(spark, sf_dir):
    """A job of three trees, then one of eight of the same forest: which trees were grown anew, and the rows of each."""
    root = train.scratch(spark)
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", (F.col("o_totalprice") > 150000).cast("int").alias("dear"))
    ask = lambda n: TrainingRequest("dear", "classification", "row_id", n, space={"max_depth": [2]}, backend="sql")
    train_job(spark, df, ask(3), root)
    whole = train_job(spark, df, ask(8), root)
    how = registry.Registry(spark, root).trees(whole.experiment_id).select("tree_index", "how")
    return how.join(whole.nodes.where("node_id = 1").select("tree_index", F.col("count").alias("drawn")), "tree_index")


_CATEGORIES = """with o as (select *, case when o_totalprice > 150000 then 1.0 else 0.0 end as dear from orders),
p as (select 'customer' as "column", case when o_custkey % 9 > 0 then concat('c', o_custkey) end as value, dear from o union all select 'day', strftime(o_orderdate, '%Y-%m-%d'), dear from o),
g as (select "column", value, count(*) as n, avg(dear) as mean from p group by 1, 2),
t as (select *, row_number() over (partition by "column" order by mean, value nulls first) - 1 as code from g)
"""


def _categories(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("dear", (F.col("o_totalprice") > 150000).cast("double"))
    return orders.select("o_orderkey", F.when(F.col("o_custkey") % 9 > 0, F.concat(F.lit("c"), "o_custkey")).alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "dear")


@query(_CATEGORIES + "select * from t")
def category_codes(spark, sf_dir):
    return encode.category_codes(_categories(spark, sf_dir), ["customer", "day"], "dear", 2)


@query(_CATEGORIES + """select o_orderkey, coalesce(case when o_custkey % 13 > 0 then c.code end, -1)::double as customer, d.code::double as day from o
left join t c on c."column" = 'customer' and c.value is not distinct from case when o_custkey % 9 > 0 then concat('c', o_custkey) end
left join t d on d."column" = 'day' and d.value = strftime(o_orderdate, '%Y-%m-%d')""")
def category_coding(spark, sf_dir):
    df = _categories(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 13 == 0, "never seen").when(F.col("o_custkey") % 9 > 0, F.concat(F.lit("c"), "o_custkey")).alias("customer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return encode.with_codes(asked, encode.category_codes(df, ["customer", "day"], "dear", 2), ["customer", "day"])


#: Two-level trees on (l_quantity, l_extendedprice): (feature, threshold), thresholds below, leaves left to right.
_TREES = [(("l_quantity", 25), ("l_extendedprice", 30000, 60000), (0, 1, 1, 2)), (("l_extendedprice", 40000), ("l_quantity", 10, 40), (0, 1, 1, 2)), (("l_discount", 0.05), ("l_quantity", 20, 30), (0, 2, 1, 2)), (("l_quantity", 35), ("l_discount", 0.03, 0.07), (1, 0, 2, 1))]


def fixed_nodes(spark) -> DataFrame:
    rows = []
    for t, ((f, x), (g, lo, hi), leaves) in enumerate(_TREES):
        fi, gi = FEATURES.index(f), FEATURES.index(g)
        rows += [(t, 1, fi, float(x), 2, 3, 0.0, 8.0, 0.3), (t, 2, gi, float(lo), 4, 5, 0.0, 4.0, 0.2), (t, 3, gi, float(hi), 6, 7, 0.0, 4.0, 0.1)]
        rows += [(t, 4 + i, -1, None, -1, -1, float(p), 2.0, 0.0) for i, p in enumerate(leaves)]
    return spark.createDataFrame(rows, train.NODES)


_CASES = [f"case when {f} <= {x} then case when {g} <= {lo} then {p[0]} else {p[1]} end else case when {g} <= {hi} then {p[2]} else {p[3]} end end" for (f, x), (g, lo, hi), p in _TREES]
_FOREST = f"select {RID_SQL} as row_id, " + ", ".join(f"{c} as t{i}" for i, c in enumerate(_CASES)) + " from lineitem"
_VOTES = f"select row_id, " + ", ".join("(" + " + ".join(f"(t{i} = {k})::int" for i in range(4)) + f") as v{k}" for k in range(3)) + f", (t0 + t1 + t2 + t3) / 4.0::double as mean from ({_FOREST})"


def scored(spark, sf_dir: str) -> DataFrame:
    return score.predict_trees(table(spark, sf_dir, "lineitem").withColumn("row_id", rid()), fixed_nodes(spark), FEATURES)


@query(f"select row_id, t0::double as p0, t1::double as p1, t2::double as p2, t3::double as p3 from ({_FOREST})")
def tree_case_predict(spark, sf_dir):
    nodes = fixed_nodes(spark).collect()
    df = table(spark, sf_dir, "lineitem")
    return df.select(rid().alias("row_id"), *[score.tree_case([r.asDict() for r in nodes if r["tree_index"] == t], FEATURES).alias(f"p{t}") for t in range(len(_TREES))])


@query(f"select row_id, t0::double as p0, t1::double as p1, t2::double as p2, t3::double as p3 from ({_FOREST})")
def tree_arrow_predict(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", *[F.get("tree_predictions", F.lit(t)).alias(f"p{t}") for t in range(len(_TREES))])


@query(f"select row_id, v0, v1, v2, case when v0 >= v1 and v0 >= v2 then 'a' when v1 >= v2 then 'b' else 'c' end as prediction from ({_VOTES})")
def forest_votes(spark, sf_dir):
    return score.vote(scored(spark, sf_dir), ["a", "b", "c"]).select("row_id", *[F.get("votes", F.lit(k)).alias(f"v{k}") for k in range(3)], "prediction")


@query(_SQL["forest_votes"])
def forest_votes_by_joins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", rid()).select("row_id", *FEATURES)
    found = score.predict_trees_by_joins(rows, fixed_nodes(spark), FEATURES)
    return score.vote(found, ["a", "b", "c"]).select("row_id", *[F.get("votes", F.lit(k)).alias(f"v{k}") for k in range(3)], "prediction")


@query(f"""with v as (select v.*, o.l_orderkey % 4 as m from ({_VOTES}) v join (select distinct {RID_SQL} as row_id, l_orderkey from lineitem) o using (row_id)),
q as (select l_orderkey, l_orderkey % 4 as m from lineitem group by l_orderkey)
select 'voter' as model_id, case when v0 >= v1 and v0 >= v2 then 'a' when v1 >= v2 then 'b' else 'c' end as label, null::varchar as error, count(*) as n, null::double as total from v where m = 0 group by 2
union all select 'meaner', null, null, count(*), round(sum(mean), 6) from v where m = 1
union all select case when m = 2 then 'absent' else 'old' end, null, case when m = 2 then 'no such model' else 'model is FAILED' end, count(*), null from q where m >= 2 group by m""")
def requests_by_model(spark, sf_dir):
    """A request for each order, each to the model that it names: one that votes, one that averages, one that isn't there,
    one that failed."""
    root = train.scratch(spark)
    for name in ("voter", "meaner"):
        io.write_nodes(fixed_nodes(spark), root, name)
    rows = [("voter", "READY", "classification", FEATURES, ["a", "b", "c"]), ("meaner", "READY", "regression", FEATURES, []), ("old", "FAILED", "regression", FEATURES, [])]
    registry.Registry(spark, root).append("models", spark.createDataFrame(rows, "model_id string, status string, task_type string, features array<string>, labels array<string>"))
    packed = io.pack_payload(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", FEATURES)
    named = packed.withColumnRenamed("l_orderkey", "request_id").withColumn("model_id", F.when(F.col("request_id") % 4 == 0, "voter").when(F.col("request_id") % 4 == 1, "meaner").when(F.col("request_id") % 4 == 2, "absent").otherwise("old"))
    out = score_requests(named, root).groupBy("model_id", "label", "error").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select("model_id", "label", "error", "n", "total")


@query(f"select row_id, mean as prediction from ({_VOTES})")
def forest_regression_mean(spark, sf_dir):
    return score.mean_prediction(scored(spark, sf_dir)).select("row_id", "prediction")


@query("select l_orderkey, label_idx, n from (select l_orderkey, l_linenumber % 3 as label_idx, count(*) as n, row_number() over (partition by l_orderkey order by count(*) desc, l_linenumber % 3) as rn from lineitem group by l_orderkey, l_linenumber % 3) where rn = 1")
def merge_class_votes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("label_idx"))
    partial = score.long_votes(rows, "l_orderkey")
    return score.winner(partial, "l_orderkey")


@query(f"select count(*) as n, avg((label = prediction)::int::double) as accuracy from (select * from ({RULE_SQL}) order by l_orderkey, l_partkey, l_suppkey, l_linenumber limit 1000)")
def head_accuracy(spark, sf_dir):
    key = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return score.head_accuracy(ruled(spark, sf_dir).withColumn("k", key), 1000, "k")


@query(f"with p as ({RULE_SQL}), l as (select label as l from p union select prediction from p) select a.l as true_label, b.l as pred_label, (select count(*) from p where p.label = a.l and p.prediction = b.l) as n from l a, l b")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(ruled(spark, sf_dir))


@query(f"select count(*) as n, round(avg((label = prediction)::int::double), 9) as accuracy from ({RULE_SQL})")
def accuracy(spark, sf_dir):
    return metrics.accuracy(ruled(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 9))


_REPORT = f"with p as ({RULE_SQL}), l as (select label as l from p union select prediction from p), r as (select l as label, sum((p.label = l and p.prediction = l)::int) as tp, sum((p.label = l)::int) as t, sum((p.prediction = l)::int) as pr from l, p group by l), m as (select label, case when pr > 0 then tp / pr else 0 end as precision, case when t > 0 then tp / t else 0 end as recall, case when t + pr > 0 then 2 * tp / (t + pr) else 0 end as f1, cast(t as bigint) as support from r) "


@query(_REPORT + "select label, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from m")
def class_report(spark, sf_dir):
    return metrics.class_report(ruled(spark, sf_dir)).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(_REPORT + "select 'macro avg' as label, round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(f1), 9) as f1, cast(sum(support) as bigint) as support from m union all select 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), cast(sum(support) as bigint) from m")
def macro_weighted_avg(spark, sf_dir):
    return metrics.averages(metrics.class_report(ruled(spark, sf_dir))).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_REG = "select l_extendedprice * (1 - l_discount) as y, l_quantity * 1500 as p from lineitem"


@query(f"with r as ({_REG}), m as (select avg(y) as ym from r) select count(*) as n, round(avg((y - p) * (y - p)), 3) as mse, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(1 - sum((y - p) * (y - p)) / sum((y - ym) * (y - ym)), 9) as r2 from r, m")
def regression_metrics(spark, sf_dir):
    m = metrics.regression_metrics(table(spark, sf_dir, "lineitem").select(net().alias("label"), (F.col("l_quantity") * 1500).alias("prediction")))
    return m.select("n", F.round("mse", 3).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("r2", 9).alias("r2"))


@query("select 'met' as kind, count(*) as n, 1.0::double as r2 from lineitem where l_quantity = 3 union all select 'missed', count(*), case when max(abs(l_quantity - 3)) = 0 then 1.0::double else 0.0::double end from lineitem")
def r2_constant_target(spark, sf_dir):
    """A constant target that is met exactly by some rows and missed by the whole table."""
    rows = table(spark, sf_dir, "lineitem").select(F.lit(3.0).alias("label"), F.col("l_quantity").alias("prediction"))
    of = lambda kind, df: metrics.regression_metrics(df).select(F.lit(kind).alias("kind"), "n", "r2")
    return of("met", rows.where("prediction = 3")).unionByName(of("missed", rows))


@query(f"select experiment_id, accuracy from (select 'exp_' || (l_suppkey % 10) as experiment_id, l_suppkey % 10 as ordinal, round(avg((label = prediction)::int::double), 6) as accuracy from ({RULE_SQL}) where l_suppkey % 10 <> 3 group by l_suppkey % 10) order by accuracy desc, ordinal limit 1")
def select_best(spark, sf_dir):
    right = F.when(F.col("label") == F.col("prediction"), 1.0).otherwise(0.0)
    e = ruled(spark, sf_dir).groupBy((F.col("l_suppkey") % 10).alias("ordinal")).agg(F.round(F.avg(right), 6).alias("a"))
    e = e.select(F.concat(F.lit("exp_"), F.col("ordinal").cast("string")).alias("experiment_id"), "ordinal", F.when(F.col("ordinal") != 3, F.col("a")).alias("accuracy"))
    return registry.select_best(e, "classification").select("experiment_id", "accuracy")


_STATUS = "case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end"


def attempts(spark, sf_dir: str) -> DataFrame:
    """orders as a log: a task for each customer, an attempt for each order."""
    o, s = table(spark, sf_dir, "orders"), F.col("o_orderstatus")
    ts = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double")
    tree = lambda k: F.format_string("exp_tree_%06d", (F.col("o_orderkey") * k) % 997)
    return o.select(
        F.concat(F.lit("task_"), F.col("o_custkey").cast("string")).alias("task_id"), F.col("o_orderkey").cast("int").alias("attempt_id"), F.when(s == "F", "COMPLETED").when(s == "O", "RUNNING").otherwise("FAILED").alias("status"), ts.alias("updated_at"),
        F.concat(F.lit("w"), (F.col("o_custkey") % 50).cast("string")).alias("worker_id"), F.array(tree(1), tree(3)).alias("tree_ids"), F.when(F.col("o_orderkey") % 5 != 0, ts + 600).alias("lease_expires_at"),
    )


_LOG = f"""with log as (select 'task_' || o_custkey as task_id, o_orderkey::int as attempt_id, {_STATUS} as status, epoch(o_orderdate)::double as updated_at, 'w' || (o_custkey % 50) as worker_id,
  [printf('exp_tree_%06d', o_orderkey % 997), printf('exp_tree_%06d', (o_orderkey * 3) % 997)] as tree_ids, case when o_orderkey % 5 <> 0 then epoch(o_orderdate)::double + 600 end as lease_expires_at from orders) """
_NOW = 900_000_000.0


@query(_LOG + "select task_id, max(attempt_id) as attempt_id, arg_max(status, attempt_id) as status, arg_max(worker_id, attempt_id) as worker_id from log group by task_id")
def latest_attempt(spark, sf_dir):
    return runlog.latest_per_key(attempts(spark, sf_dir).select("task_id", "attempt_id", "status", "worker_id"), ["task_id"], "attempt_id")


@query(_LOG + "select item, min(attempt_id) as first_at from (select attempt_id, unnest(tree_ids) as item from log where status = 'COMPLETED') group by item")
def completed_ids(spark, sf_dir):
    return runlog.distinct_items(attempts(spark, sf_dir).where("status = 'COMPLETED'"), "tree_ids", "attempt_id")


@query(_LOG + "select task_id, bool_or(status = 'COMPLETED') as completed from log group by task_id")
def task_completed(spark, sf_dir):
    return runlog.any_completed(attempts(spark, sf_dir), "task_id")


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_partkey is not null and l_linenumber = 1)")
def missing_ids(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("p_partkey"))
    return runlog.missing_keys(table(spark, sf_dir, "part").select("p_partkey"), done, "p_partkey")


@query("with i as (select distinct l_suppkey, l_orderkey from lineitem), g as (select l_suppkey, l_orderkey, l_orderkey - row_number() over (partition by l_suppkey order by l_orderkey) as k from i) select l_suppkey, min(l_orderkey) as start, count(*) as n from g group by l_suppkey, k")
def id_ranges(spark, sf_dir):
    return runlog.id_ranges(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


_IDS = "select o_orderkey, case when o_orderkey % 4 = 0 then 'exp_tree_' || (o_orderkey % 200) else printf('exp_tree_%06d', o_orderkey % 200) end as id from orders"


@query(f"select o_orderkey, (o_orderkey % 200)::int as index, (o_orderkey % 200) < 100 and id = printf('exp_tree_%06d', o_orderkey % 200) as valid from ({_IDS})")
def tree_id_check(spark, sf_dir):
    k = F.col("o_orderkey") % 200
    ids = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("exp_tree_"), k.cast("string"))).otherwise(F.format_string("exp_tree_%06d", k)).alias("id"))
    return runlog.check_ids(ids, "exp", "id", 100).select("o_orderkey", "index", "valid")


@query("select o_orderkey, printf('exp_trees_%06d_%06d', o_orderkey, o_orderkey + o_custkey % 9) as label from orders")
def range_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", runlog.range_label(F.lit("exp"), F.col("o_orderkey"), F.col("o_custkey") % 9 + 1).alias("label"))


@query(_LOG + f"select task_id, attempt_id, lease_expires_at from log where status = 'RUNNING' and lease_expires_at <= {_NOW}")
def expired_attempts(spark, sf_dir):
    return runlog.expired(attempts(spark, sf_dir), _NOW).select("task_id", "attempt_id", "lease_expires_at")


_OWNER = "o as (select item, worker_id, lease_expires_at from (select *, row_number() over (partition by item order by updated_at desc, attempt_id desc) as rn from (select *, unnest(tree_ids) as item from log where status = 'RUNNING')) where rn = 1)"


@query(_LOG + f", {_OWNER} select * from o")
def tree_owner(spark, sf_dir):
    return runlog.owner_per_item(attempts(spark, sf_dir))


_LIVE = "v as (select worker_id, greatest(0, {now} - max(updated_at)) > {t} as stale, greatest(0, {now} - max(updated_at))::double as age from log group by worker_id)".format(now=_NOW, t=864_000.0)


@query(_LOG + f", {_LIVE} select worker_id, age, stale from v")
def liveness_snapshot(spark, sf_dir):
    return runlog.liveness(attempts(spark, sf_dir), "worker_id", "updated_at", _NOW, 864_000.0)


@query(_LOG + f""", {_OWNER}, {_LIVE}, e as (select distinct printf('exp_tree_%06d', o_custkey % 1200) as item from orders), x as (select item, worker_id, lease_expires_at, coalesce(stale, true) as gone, {_NOW} - lease_expires_at as late from e left join o using (item) left join v using (worker_id)),
r as (select item, case when worker_id is null then 'no_owner' when lease_expires_at is null and gone then 'no_lease_stale' when lease_expires_at is null then 'no_lease_live' when late < 0 then 'lease_live' when gone then 'expired_stale' when late <= 30 then 'expired_in_grace' else 'expired_over_grace' end as reason from x)
select item, case when reason in ('no_owner', 'no_lease_stale', 'expired_stale', 'expired_over_grace') then 'recover_now' else 'defer' end as action, reason from r""")
def abandoned_report(spark, sf_dir):
    log = attempts(spark, sf_dir)
    items = table(spark, sf_dir, "orders").select(F.format_string("exp_tree_%06d", F.col("o_custkey") % 1200).alias("item")).distinct()
    return runlog.abandoned_report(items, runlog.owner_per_item(log), runlog.liveness(log, "worker_id", "updated_at", _NOW, 864_000.0), _NOW)


@query("select event_id, case when event_id % 16 in (0, 1, 2, 15) then 'timeout' when event_id % 16 between 3 and 9 then 'worker_failure' else 'unknown' end as category from events")
def error_category(spark, sf_dir):
    """Each marker once, then what only looks like one, null, and a message with markers of both kinds."""
    texts = ("Timeout: ", "DEADLINE EXCEEDED ", "it timed out ", "Unavailable ", "connection refused by ", "Connection reset ", "broken pipe ", "Transport closed ", "a Worker said ", "RPC ", "deadline ", "connection ", "bad value ", "pipe ", None, "worker timed out ")
    k = (F.col("event_id") % 16).cast("int")
    message = F.concat(F.get(F.array(*map(F.lit, texts)), k), "event_type")
    return table(spark, sf_dir, "events").select("event_id", runlog.error_category(message).alias("category"))


@query(_LOG + "select attempt_id, case when tree_ids[1] = tree_ids[2] then tree_ids[1] || case when worker_id = tree_ids[1] then '' else '|' || worker_id end else tree_ids[1] || '|' || tree_ids[2] || '|' || worker_id end as ids from log")
def id_list_merge(spark, sf_dir):
    return attempts(spark, sf_dir).select("attempt_id", F.array_join(runlog.merge_ids(F.col("tree_ids"), F.array("worker_id")), "|").alias("ids"))


@query(_LOG + "select worker_id, count(*) as n from log group by worker_id")
def trees_per_worker(spark, sf_dir):
    return runlog.trees_per(attempts(spark, sf_dir), "worker_id")


@query(_LOG + "select count(*) as workers, cast(sum(n) as bigint) as trees, min(n) as least, max(n) as most, max(n) - min(n) <= 1 as even from (select worker_id, count(*) as n from log group by worker_id)")
def even_distribution(spark, sf_dir):
    return runlog.evenly_distributed(attempts(spark, sf_dir), "worker_id")


@query(_LOG + "select task_id, attempt_id, (attempt_id % 3) / 2.0::double as progress from log where status = 'RUNNING'")
def progress(spark, sf_dir):
    log = attempts(spark, sf_dir).withColumn("completed", F.slice("tree_ids", F.lit(1), F.col("attempt_id") % 3))
    return runlog.progress(log).select("task_id", "attempt_id", "progress")


@query(_LOG + "select task_id, case when attempt_id % 3 = 0 then 1 else attempt_id end as attempt_id, status, worker_id from log")
def ledger_flatten(spark, sf_dir):
    """Documents of both forms are made from the log, then flattened; every third is of the old form, attempt 1."""
    log = attempts(spark, sf_dir)
    rec = F.struct("attempt_id", "status", "updated_at", "worker_id", F.col("tree_ids").alias("completed"), F.slice("tree_ids", 1, 0).alias("failed"))
    new = F.to_json(F.struct(F.create_map(F.col("task_id"), F.struct(F.create_map(F.col("attempt_id").cast("string"), rec).alias("attempts"))).alias("tasks")))
    doc = F.when(F.col("attempt_id") % 3 == 0, F.to_json(F.struct(F.create_map(F.col("task_id"), rec).alias("tasks")))).otherwise(new)
    return runlog.flatten_ledger(log.select(doc.alias("doc"))).select("task_id", "attempt_id", "status", "worker_id")


@query("select 'exp_' || o_custkey as experiment_id, count(*) as n_trees, min(o_orderkey) as first_tree, max(o_orderkey) as last_tree from orders where o_orderstatus = 'F' group by 1")
def manifest_trees(spark, sf_dir):
    trees = attempts(spark, sf_dir).select(F.regexp_replace("task_id", "task_", "exp_").alias("experiment_id"), F.col("attempt_id").cast("long").alias("tree_index"), F.get("tree_ids", F.lit(0)).alias("tree_id"), "status")
    return registry.build_manifest(trees).select("experiment_id", "n_trees", F.element_at("trees", 1)["tree_index"].alias("first_tree"), F.element_at("trees", -1)["tree_index"].alias("last_tree"))


@query("select o_custkey, max(o_orderkey) as o_orderkey, arg_max(s, o_orderkey) filter (s is not null) as s, arg_max(p, o_orderkey) filter (p is not null) as p from (select o_custkey, o_orderkey, case when o_orderkey % 3 <> 0 then o_orderstatus end as s, case when o_orderkey % 4 <> 0 then o_orderpriority end as p from orders) group by o_custkey")
def registry_latest_state(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("s"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("p"))
    return registry.latest_state(rows, "o_custkey", "o_orderkey")


@query("select o_orderkey as tree_index, case when o_orderkey % 2 = 0 then 'r' || o_orderkey else 's' || o_orderkey end as tree_id from orders where case when o_orderkey % 2 = 0 then o_orderstatus = 'F' else o_orderkey % 3 = 0 and o_orderstatus <> 'F' end")
def final_tree_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "tree_index")
    id = F.col("tree_index").cast("string")
    results = o.where("tree_index % 2 = 0").select("tree_index", F.concat(F.lit("r"), id).alias("tree_id"), F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("FAILED").alias("status"))
    kept = o.where("tree_index % 3 = 0").select("tree_index", F.concat(F.lit("s"), id).alias("tree_id"), F.when(F.col("o_orderstatus") != "F", "COMPLETED").otherwise("FAILED").alias("status"))
    return registry.final_trees(o.select("tree_index"), results, kept)


@query("select vec_id, i::int as row_no, embedding[i * 16 + 1]::double as first, embedding[i * 16 + 16]::double as last from embeddings, range(4) t(i)")
def dense_payload_explode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"), F.lit(4).alias("n_rows"), F.lit(16).alias("n_cols"))
    return io.explode_payload(e, "vec_id", "values", "n_rows", "n_cols").select("vec_id", "row_no", F.element_at("features", 1).alias("first"), F.element_at("features", -1).alias("last"))


@query("select l_orderkey, count(*) as n_rows, arg_min(l_quantity, (l_linenumber, l_partkey, l_suppkey)) as first, arg_max(l_tax, (l_linenumber, l_partkey, l_suppkey)) as last from lineitem group by l_orderkey")
def dense_payload_pack(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return io.pack_payload(df, "l_orderkey", "k", ["l_quantity", "l_tax"]).select("l_orderkey", F.col("n_rows").cast("long").alias("n_rows"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"))


@query("select 'w' || (o_custkey % 50) as worker_id, o_orderkey from orders where o_orderstatus = 'F' and o_orderkey not in (select l_orderkey from lineitem)")
def claims_without_artifact(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("w"), (F.col("o_custkey") % 50).cast("string")).alias("worker_id"), "o_orderkey")
    return runlog.claims_without_artifact(claims, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query()
def forest_pipeline(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def ml_forest_fit(spark, sf_dir):
    rows = train.stored(scenario.to_double(labelled(spark, sf_dir).select("row_id", "is_large", *FEATURES), FEATURES))
    return train.fit_forest_ml(rows, FEATURES, "is_large", ForestConfig(4, 5, min_samples_split=20))


@query()
def sql_forest_fit(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("row_id", "is_large", *FEATURES)
    return train.fit_forest_sql(rows, FEATURES, "is_large", ForestConfig(4, 3), n_classes=2)


@query()
def feature_importances(spark, sf_dir):
    return metrics.feature_importances(ml_forest_fit(spark, sf_dir), FEATURES)


@query()
def regression_job(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(rid().alias("row_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", (net() * (1 + F.col("l_tax"))).alias("charge"))
    return train_job(spark, df, TrainingRequest("charge", "regression", "row_id", 4, space={"max_depth": [5], "criterion": ["squared_error"]})).experiments


@query()
def scenario_comparison(spark, sf_dir):
    df = labelled(spark, sf_dir).withColumn("net", net()).select("row_id", "is_large", *FEATURES, "l_linestatus", "net")
    request = TrainingRequest("is_large", "classification", "row_id", 4, leakage=["net"], space={"max_depth": [5]})
    return compare_scenarios(spark, df, request, ["baseline_original", "baseline_no_leakage", Scenario(keep=("l_quantity", "l_discount"), name="two")])


def streamed(spark, out: DataFrame) -> DataFrame:
    """The rows that a stream has written by the end of what is there."""
    path = train.scratch(spark)
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def stream_of(spark, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def closed_stream(spark, sf_dir: str, name: str, ts: str) -> DataFrame:
    """A stream of the table and, after it, of one row far later whose other columns are null: it moves the watermark
    past all else, so that the last windows and open sessions come out. The later row's own is never closed."""
    path, df = train.scratch(spark), table(spark, sf_dir, name)
    df.write.parquet(f"{path}/0")
    last = df.agg((F.max(F.col(ts).cast("timestamp")) + F.expr("interval 3650 days")).cast(df.schema[ts].dataType).alias(ts))
    last.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]).coalesce(1).write.parquet(f"{path}/1")
    return spark.readStream.schema(df.schema).parquet(f"{path}/*")


@query("""with g as (select user_id, ts::timestamp as ts, case when ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as since, max(ts) + interval 12 hours as stale_at, count(*) as events from s group by user_id, k""")
def stream_liveness(spark, sf_dir):
    return streamed(spark, streams.liveness_stream(closed_stream(spark, sf_dir, "events", "ts"), "user_id", "ts", "12 hours"))


@query("""with g as (select user_id, ts::timestamp as ts, case when ts::timestamp - lag(ts::timestamp) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as at, 'live' as state from s group by user_id, k union all select user_id, max(ts) + interval 12 hours, 'stale' from s group by user_id, k""")
def stream_liveness_transitions(spark, sf_dir):
    told = streamed(spark, liveness_transitions(closed_stream(spark, sf_dir, "events", "ts"), "user_id", "ts", "12 hours"))
    return told.where("user_id is not null")  # the closing row's


@query("select event_type as model_id, date_trunc('day', ts::timestamp) as start, date_trunc('day', ts::timestamp) + interval 1 day as \"end\", count(*) as n, avg(case when event_id % 2 = user_id % 2 then 1.0 else 0.0 end) as accuracy from events group by 1, 2")
def stream_accuracy(spark, sf_dir):
    e = closed_stream(spark, sf_dir, "events", "ts").withColumns({"model_id": F.col("event_type"), "label": F.col("event_id") % 2, "prediction": F.col("user_id") % 2})
    return streamed(spark, streams.accuracy_stream(e, "ts", window="1 day"))


@query("select vec_id as request_id, 0 as row_no, case when embedding[1] <= 0 then 'a' else 'b' end as prediction from embeddings")
def stream_predict(spark, sf_dir):
    nodes = spark.createDataFrame([(0, 1, 0, 0.0, 2, 3, 0.0, 2.0, 0.5), (0, 2, -1, None, -1, -1, 0.0, 1.0, 0.0), (0, 3, -1, None, -1, -1, 1.0, 1.0, 0.0)], train.NODES)
    e = stream_of(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("request_id"), F.col("embedding").cast("array<double>").alias("values"), F.lit(1).alias("n_rows"), F.lit(64).alias("n_cols"))
    return streamed(spark, streams.predict_stream(e, nodes, [f"x{i}" for i in range(64)], ["a", "b"]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
