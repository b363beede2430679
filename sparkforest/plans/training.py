"""From a table to a published model: scenario, encoding, splits, grid, fit, selection, test, manifest."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkforest.operators import encode, grid, grow, metrics, registry, scenario, score, split, validate
from sparkforest.operators.train import fit_forest_ml, fit_forest_sql, laid_out, stored
from sparkforest.plans.models import Model, publish
from sparkforest.sources import io


@dataclass(frozen=True)
class TrainingRequest:
    target: str
    task_type: str
    row_id: str
    n_estimators: int = 4
    scenario: str | scenario.Scenario | None = None
    leakage: list[str] | None = None
    space: dict = field(default_factory=dict)
    validation_ratio: float = 0.2
    test_ratio: float = 0.2
    seed: int = 42
    backend: str = "ml"
    metric: str = "auto"
    exact_split: bool = False
    #: What missing numbers are: see ``validate.MISSING``.
    missing: str = "error"
    #: Quantiles that cut a feature in the sql backend; None: all values.
    bins: int | None = 32
    #: Trees that the sql backend grows at a time, which a resumed job needn't grow again; None: all.
    wave: int | None = None
    #: How the sql backend draws a tree's sample: see ``grow.grow_forest``.
    draws: str = "poisson"
    #: String columns with more values than one-hot columns are made for: an error, or codes in the order of the label.
    categories: str = "error"


@dataclass
class TrainingResult:
    job_id: str
    experiment_id: str
    features: list[str]
    labels: list[str] | None
    vocab: dict[str, list[str]]
    nodes: DataFrame
    experiments: DataFrame
    validation: dict
    test: dict | None
    importances: DataFrame
    report: dict

    model: Model

    def predict(self, df: DataFrame) -> DataFrame:
        """Raw rows in, predictions out: the model's vocabulary encodes them."""
        return self.model.predict(df)


def train(spark: SparkSession, source: str | DataFrame, request: TrainingRequest, root: str | None = None, job_id: str | None = None) -> TrainingResult:
    """Train the grid, pick the best experiment on the validation split, test it, and (with ``root``) publish it.

    With ``root``, the job's state is a row of the registry from the start (RUNNING, then COMPLETED or FAILED), and
    trees are stored as soon as they are grown, wave by wave, under a key of all that decides them: see ``content_key``.
    A job that is run again, under any id, grows only trees that aren't there; another request or other data share none.
    A feature that lacks values is an error before the fit, unless ``missing`` says otherwise.
    """
    validate.validate_request(request)
    job_id = job_id or io.new_id("job")
    reg = registry.Registry(spark, root) if root else None
    if reg:
        reg.append("jobs", spark.range(1).select(F.lit(job_id).alias("job_id"), F.lit("RUNNING").alias("status"), F.unix_timestamp().cast("double").alias("created_at"), F.lit(request.target).alias("target")))
    try:
        return _train(spark, source, request, root, job_id, reg)
    except Exception as e:
        if reg:
            reg.fail(job_id, None, f"{type(e).__name__}: {e}"[:2000])
        raise


def rows_digest(rows: DataFrame, features: list[str]) -> tuple[int, str, int]:
    """Number of rows and two sums of their hashes, which don't depend on order."""
    fields = [F.col(f"`{c}`") for c in ("row_id", "label", *features)]
    one = lambda salt: F.xxhash64(F.lit(salt), *fields, *[c.isNull() for c in fields])
    row = rows.agg(F.count("*").alias("n"), F.sum(one(1).cast("decimal(38,0)")).alias("s"), F.bit_xor(one(2)).alias("x")).first()
    return row["n"], str(row["s"]), row["x"]


def content_key(digest: tuple[int, str, int], features: list[str], labels: list[str] | None, config: grid.ForestConfig, request: TrainingRequest) -> str:
    """Names what decides a tree beside its index: training rows (their digest), features, labels, parameters, seed,
    backend. Spark's trainer draws for all trees together, so their number counts there."""
    parts = asdict(config) | {"n_estimators": config.n_estimators if request.backend == "ml" else None}
    what = [request.backend, (request.bins, request.draws) if request.backend == "sql" else None, features, labels, parts, *digest]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()


def _forests(rows: DataFrame, features: list[str], labels: list[str] | None, configs: list[grid.ForestConfig], request: TrainingRequest, root: str | None, laid: bool = False) -> list[tuple[DataFrame, list[tuple]]]:
    """For each experiment (nodes, [(tree_index, how, seconds and trees of its wave, n_nodes)]): trees that are stored whole
    are taken, the others are grown and stored by waves. In the sql backend a wave has trees of all experiments, which grow
    in the same passes over the rows; Spark's trainer takes one experiment after the other. ``laid``: see ``fit_forest_ml``."""
    spark, sql = rows.sparkSession, request.backend == "sql"
    digest = rows_digest(rows, features) if root else None
    keys = [content_key(digest, features, labels, c, request) if root else str(e) for e, c in enumerate(configs)]
    lacks: dict[int, list[int]] = {}
    for e, c in enumerate(configs):
        there = io.whole_trees(spark, root, keys[e])[1] if root else {}
        gone = [i for i in range(c.n_estimators) if i not in there]
        if gone and keys.index(keys[e]) == e:  # equal experiments are one
            lacks[e] = gone if sql else list(range(c.n_estimators))
    took: dict[tuple[str, int], tuple[float, int]] = {}
    own: dict[int, list[DataFrame]] = {e: [] for e in range(len(configs))}

    def keep(e: int, grown: DataFrame) -> None:
        io.write_trees(grown, root, keys[e]) if root else own[e].append(grown)

    classes, longest = len(labels) if labels else None, max(map(len, lacks.values()), default=0)
    step = request.wave or longest
    for at in range(0, longest if sql else 0, max(1, step)):
        wave, began = {e: x for e, all_of in lacks.items() if (x := all_of[at : at + step])}, time.time()
        order = list(wave)
        if len(order) == 1:
            e = order[0]
            keep(e, stored(fit_forest_sql(rows, features, "label", configs[e], n_classes=classes, bins=request.bins, trees=wave[e], draws=request.draws)))
        else:
            grown = stored(grow.grow_grid(rows, features, "label", [configs[e] for e in order], n_classes=classes, bins=request.bins, trees=[wave[e] for e in order], draws=request.draws))
            for k, e in enumerate(order):
                keep(e, grown.where(F.col("experiment") == k).drop("experiment"))
        took |= {(keys[e], i): (time.time() - began, sum(map(len, wave.values()))) for e in order for i in wave[e]}
    for e in () if sql else lacks:
        began = time.time()
        keep(e, fit_forest_ml(rows, features, "label", configs[e], classification=labels is not None, laid=laid))
        took |= {(keys[e], i): (time.time() - began, len(lacks[e])) for i in lacks[e]}
    out = []
    for e, c in enumerate(configs):
        if root:
            nodes, whole = io.whole_trees(spark, root, keys[e])
            if gone := [i for i in range(c.n_estimators) if i not in whole]:
                raise RuntimeError(f"trees {gone} were written and aren't whole")
            nodes = nodes.where(F.col("tree_index") < c.n_estimators)
        else:
            nodes = own[e][0]
            for x in own[e][1:]:
                nodes = nodes.unionByName(x)
            whole = {r["tree_index"]: r["n"] for r in nodes.groupBy("tree_index").agg(F.count("*").alias("n")).collect()}
        out.append((nodes, [(i, "GROWN" if (keys[e], i) in took else "RESUMED", *took.get((keys[e], i), (None, None)), whole[i]) for i in range(c.n_estimators)]))
    return out


@dataclass
class Prepared:
    """The rows of a job, ready for its fits, and what made them so."""

    schema: validate.DatasetSchema
    vocab: dict[str, list[str]]
    coded: list[str]
    codes: DataFrame | None
    labels: list[str] | None
    features: list[str]
    parted: DataFrame
    ready: DataFrame
    fill: dict[str, float]
    indicators: list[str]


def _prepare(df: DataFrame, body: DataFrame, request: TrainingRequest) -> Prepared:
    """Checks, encodes, splits and stores the rows of ``df``, with the columns of ``body``."""
    schema = validate.validate(body, request.target, request.task_type)
    validate.check_types(body, schema.features)
    kept = df.select(request.row_id, *[F.col(f"`{c}`") for c in body.columns])
    strings, coded = encode.string_columns(body, request.target), []
    if request.categories == "codes":
        strings, coded = encode.divide_columns(body, strings)
    vocab = encode.fit_vocab(body.drop(*coded), strings)
    encoded = encode.one_hot(kept, vocab, request.target)
    parted = split.assign_splits(encoded, validation_ratio=request.validation_ratio, test_ratio=request.test_ratio, seed=request.seed, row_id=request.row_id, target=request.target, task_type=schema.task_type, exact=request.exact_split)
    labels = list(schema.label_mapping) if schema.label_mapping else None
    features = [c for c in encoded.columns if c not in (request.row_id, request.target)]
    label = F.array_position(F.lit(labels), F.col(request.target).cast("string")).cast("double") - 1 if labels else F.col(request.target).cast("double")
    codes = None
    if coded:  # by the training rows alone
        codes = stored(encode.category_codes(parted.where("split = 'train'").withColumn("_label", label), coded, "_label", len(labels) if labels else None))
        parted = encode.with_codes(parted, codes, coded)
    ready = train_table(parted, features, request, label)
    fill, indicators = {}, []
    if request.missing == "error":
        validate.check_missing(ready, features)
    elif request.missing == "indicator_median":
        numbers = [c for c in schema.features if c not in vocab and c not in coded]
        fill, indicators = encode.medians(ready.where("split = 'train'"), numbers), list(validate.missing_counts(ready, numbers))
        ready, features = encode.fill_missing(ready, fill, indicators), [*features, *[f"{c}_missing" for c in indicators]]
    return Prepared(schema, vocab, coded, codes, labels, features, parted, ready, fill, indicators)


def _plan(spark: SparkSession, job_id: str, request: TrainingRequest, task_type: str) -> list[tuple]:
    """The grid's experiments in order, each with its parameters."""
    plan = grid.plan_grid(spark, job_id, request.space, task_type).orderBy("ordinal").collect()
    return [(e, grid.ForestConfig(request.n_estimators, e["max_depth"], e["max_features"], e["min_samples_split"], e["min_samples_leaf"], e["criterion"], True, request.seed)) for e in plan]


def _experiments(spark: SparkSession, plan: list[tuple], measured: list[dict], completed: list[int]) -> DataFrame:
    rows = [(e["experiment_id"], e["ordinal"], *[m[k] for k in ("accuracy", "mse", "rmse", "r2")], config.n_estimators, n) for (e, config), m, n in zip(plan, measured, completed)]
    return spark.createDataFrame(rows, "experiment_id string, ordinal int, accuracy double, mse double, rmse double, r2 double, expected_trees int, completed_trees int")


def _train(spark: SparkSession, source: str | DataFrame, request: TrainingRequest, root: str | None, job_id: str, reg: registry.Registry | None) -> TrainingResult:
    df = io.load(spark, source) if isinstance(source, str) else source
    body, report = scenario.apply_scenario(df.drop(request.row_id), request.target, request.scenario, request.leakage)
    made = _prepare(df, body, request)
    schema, vocab, coded, codes, labels, features, ready = made.schema, made.vocab, made.coded, made.codes, made.labels, made.features, made.ready
    if root:
        row = (schema.target, schema.task_type, features, labels or [])
        io.write_prepared(made.parted, root, job_id, schema_row=spark.createDataFrame([row], "target string, task_type string, features array<string>, labels array<string>"), report_row=scenario.scenario_report(df, report))
    plan = _plan(spark, job_id, request, schema.task_type)
    tried = [config for _, config in plan]
    forests = _forests(ready.where("split = 'train'"), features, labels, tried, request, root)
    measured = measure_each(ready.where("split = 'validation'"), [nodes for nodes, _ in forests], [c.n_estimators for c in tried], features, labels, schema.task_type)
    trees, fitted, configs = [], {}, {}
    for (e, config), (nodes, grown) in zip(plan, forests):
        name = e["experiment_id"]
        trees += [(f"{name}_tree_{i:06d}", job_id, name, i, config.seed + i, "COMPLETED", how, seconds, wave, n) for i, how, seconds, wave, n in grown]
        fitted[name], configs[name] = nodes, config
    experiments = _experiments(spark, plan, measured, [len(grown) for _, grown in forests])
    best = registry.select_best(experiments, schema.task_type, request.metric).first()
    nodes, name = fitted[best["experiment_id"]], best["experiment_id"]
    test = measure(ready.where("split = 'test'"), nodes, features, labels, schema.task_type) if request.test_ratio > 0 else None
    model_id = _model_id(spark, root, job_id, nodes) if root else f"model_{job_id}"
    model = Model(model_id, job_id, name, schema.task_type, request.target, features, labels, vocab, configs[name], {"validation": {k: best[k] for k in ("accuracy", "mse", "rmse", "r2")}, "test": test}, nodes, made.fill, made.indicators, coded, codes)
    if reg:
        tree_rows = spark.createDataFrame(trees, "tree_id string, job_id string, experiment_id string, tree_index int, seed long, status string, how string, wave_seconds double, wave_trees int, n_nodes long")
        reg.append("trees", tree_rows)
        reg.append("experiments", experiments.withColumn("job_id", F.lit(job_id)).withColumn("status", F.lit("COMPLETED")))
        io.write_nodes(nodes, root, model.model_id)
        if coded:
            io.write_codes(codes, root, model.model_id)
        for part in ("validation", *(["test"] if test else [])):
            records(_scored(ready.where(F.col("split") == part), nodes, features, labels), schema.task_type, reg, job_id, name, part)
        publish(spark, root, model, tree_rows.where(F.col("experiment_id") == name))
        reg.append("jobs", spark.createDataFrame([(job_id, "COMPLETED", name, model.model_id)], "job_id string, status string, selected_experiment_id string, model_id string"))
    return TrainingResult(job_id, name, features, labels, vocab, nodes, experiments, best.asDict(), test, metrics.feature_importances(nodes, features), report, model)


def _model_id(spark: SparkSession, root: str, job_id: str, nodes: DataFrame) -> str:
    """``model_`` and the job; with a digest of the trees behind, where the job has published other trees before."""
    name, there = f"model_{job_id}", io.stored_nodes(spark, root, f"model_{job_id}")
    digests = lambda x: {r["tree_index"]: r["digest"] for r in io.tree_digests(x).collect()}
    new = digests(nodes)
    if there is None or digests(there) in ({}, new):
        return name
    return f"{name}_{hashlib.sha256(str(sorted(new.items())).encode()).hexdigest()[:12]}"


def records(scored: DataFrame, task_type: str, reg: registry.Registry, job_id: str, experiment_id: str, part: str) -> None:
    """The metrics record of a split, as rows: the class report with its averages and the confusion matrix, or the
    regression metrics."""
    where = [F.lit(job_id).alias("job_id"), F.lit(experiment_id).alias("experiment_id"), F.lit(part).alias("split")]
    if task_type == "classification":
        report = metrics.class_report(scored)
        reg.append("reports", report.unionByName(metrics.averages(report)).select(*where, "*"))
        reg.append("confusion", metrics.confusion_matrix(scored).select(*where, "*"))
    reg.append("metrics", metrics.evaluate(scored, task_type).select(*where, "*"))


def train_table(parted: DataFrame, features: list[str], request: TrainingRequest, label) -> DataFrame:
    """The prepared rows, written once and read by every fit."""
    doubles = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    return stored(parted.select(F.col(request.row_id).alias("row_id"), "split", label.alias("label"), *doubles))


def _truth(rows: DataFrame, labels: list[str] | None) -> DataFrame:
    return rows.withColumn("label", F.element_at(F.lit(labels), F.col("label").cast("int") + 1)) if labels else rows


def _scored(rows: DataFrame, nodes: DataFrame, features: list[str], labels: list[str] | None) -> DataFrame:
    return score.predict(_truth(rows, labels), nodes, features, labels)


def measure(rows: DataFrame, nodes: DataFrame, features: list[str], labels: list[str] | None, task_type: str) -> dict:
    if rows.isEmpty():
        raise ValueError("a split is empty")
    return metrics.evaluate(_scored(rows, nodes, features, labels), task_type).first().asDict()


def measure_each(rows: DataFrame, forests: list[DataFrame], sizes: list[int], features: list[str], labels: list[str] | None, task_type: str) -> list[dict]:
    """As ``measure``, of several forests (``sizes``: their numbers of trees) in one pass over the rows."""
    if rows.isEmpty():
        raise ValueError("a split is empty")
    starts = [sum(sizes[:e]) for e in range(len(sizes))]
    nodes = None
    for start, forest in zip(starts, forests):
        moved = forest.withColumn("tree_index", F.col("tree_index") + start)
        nodes = moved if nodes is None else nodes.unionByName(moved)
    every = F.explode(F.array(*[F.struct(F.lit(e).alias("experiment"), F.lit(start + 1).alias("first"), F.lit(n).alias("n")) for e, (start, n) in enumerate(zip(starts, sizes))])).alias("_e")
    scored = score.predict_trees(_truth(rows, labels), nodes, features).select("label", "tree_predictions", every)
    own = scored.select("label", "_e.experiment", F.slice("tree_predictions", F.col("_e.first"), F.col("_e.n")).alias("tree_predictions"))
    predicted = score.vote(own, labels) if labels is not None else score.mean_prediction(own)
    found = {r["experiment"]: r.asDict() for r in metrics.evaluate_each(predicted, task_type, "experiment").collect()}  # a row for each experiment
    return [found[e] for e in range(len(sizes))]


def compare_scenarios(spark: SparkSession, source: str | DataFrame, request: TrainingRequest, scenarios: list) -> DataFrame:
    """The chosen experiment's validation metrics of each scenario, side by side.

    Encoding, splits and the trainer's layout of the rows don't depend on the scenario: they are made once for a scenario and
    all those whose columns it has, and each fit takes its own columns. Codes do depend on which columns there are, so with
    these each scenario is a job of its own. Test rows take no part.
    """
    metric = lambda m: [m[k] for k in ("accuracy", "mse", "rmse", "r2")]
    schema = "scenario string, n_features int, accuracy double, mse double, rmse double, r2 double"
    requests = [TrainingRequest(**{**request.__dict__, "scenario": s}) for s in scenarios]
    if request.categories == "codes":
        done = [train(spark, source, r) for r in requests]
        return spark.createDataFrame([(scenario.resolve(s).name, len(r.features), *metric(r.validation)) for s, r in zip(scenarios, done)], schema)
    for r in requests:
        validate.validate_request(r)
    df = io.load(spark, source) if isinstance(source, str) else source
    whole = df.drop(request.row_id)
    bodies = [scenario.apply_scenario(whole, request.target, r.scenario, request.leakage)[0] for r in requests]
    columns = [set(b.columns) for b in bodies]
    widest = sorted(range(len(bodies)), key=lambda i: -len(columns[i]))
    host = [next(h for h in widest if columns[h] >= own) for own in columns]
    found = {}
    for h in dict.fromkeys(host):
        made = _prepare(df, bodies[h], request)
        plan, task = _plan(spark, io.new_id("job"), request, made.schema.task_type), made.schema.task_type
        tried, ml = [config for _, config in plan], request.backend == "ml"
        fitted, rest = ready_for(made.ready.where("split = 'train'"), made.features, ml), made.ready.where("split = 'validation'")
        for i in (i for i in range(len(bodies)) if host[i] == h):
            own = {c: v for c, v in made.vocab.items() if c in columns[i]}
            features = [c for c in encode.one_hot(bodies[i], own, request.target).columns if c != request.target]
            features += [f"{c}_missing" for c in made.indicators if c in features]
            forests = _forests(fitted, features, made.labels, tried, request, None, laid=ml)
            measured = measure_each(rest, [nodes for nodes, _ in forests], [c.n_estimators for c in tried], features, made.labels, task)
            best = registry.select_best(_experiments(spark, plan, measured, [len(grown) for _, grown in forests]), task, request.metric).first()
            found[i] = (scenario.resolve(requests[i].scenario).name, len(features), *metric(best))
        if ml:
            fitted.unpersist()
    return spark.createDataFrame([found[i] for i in range(len(bodies))], schema)


def ready_for(rows: DataFrame, features: list[str], ml: bool) -> DataFrame:
    """For several fits by Spark's trainer: rows in its layout, kept in memory and on disk. Other rows as they are."""
    return laid_out(rows).select("label", *[F.col(f"`{c}`") for c in features]).persist() if ml else rows
