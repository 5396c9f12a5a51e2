"""Attributions of a fitted model back to source features."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loanloom.errors import ContractError
from loanloom.functions.reshape import long_rows
from loanloom.operators.evaluation import rank_metrics
from loanloom.operators.cohorts import hash_order
from loanloom.operators.prefix import ranked
from loanloom.operators.training import Fitted
from loanloom.session import ensure_checkpoint_dir

TOP = 5


def background_means(fitted: Fitted, background: DataFrame) -> dict[str, float]:
    """Mean of every prepared column over the background rows: one number per column."""
    prep = fitted.preparation
    prepared = background.select(*prep.expressions())
    row = prepared.agg(*[F.avg(f"`{n}`").alias(f"m{i}") for i, n in enumerate(prep.names())]).first()
    return {n: row[f"m{i}"] for i, n in enumerate(prep.names())}


def linear_contributions(fitted: Fitted, df: DataFrame, means: dict[str, float], keep: Sequence[str]) -> DataFrame:
    """Per row: contribution of each source feature, base value and margin of a linear model.

    The encoded columns of a category are summed back to their source feature.
    """
    if fitted.name != "logistic_regression":
        raise ContractError("Linear attribution needs a linear model")
    prep, names = fitted.preparation, fitted.preparation.names()
    weights = dict(zip(names, [float(c) for c in fitted.model.coefficients.toArray()]))
    intercept = float(fitted.model.intercept)
    prepared = df.select(*keep, *prep.expressions())
    parts: dict[str, Column] = {}
    for n in names:
        term = F.lit(weights[n]) * (F.col(f"`{n}`") - F.lit(means[n]))
        source = prep.origins()[n]
        parts[source] = parts[source] + term if source in parts else term
    base = intercept + sum(weights[n] * means[n] for n in names)
    margin = F.lit(intercept)
    for n in names:
        margin = margin + F.lit(weights[n]) * F.col(f"`{n}`")
    return prepared.select(
        *keep, F.lit(base).alias("base_value"), margin.alias("margin"), *[v.alias(f"c_{k}") for k, v in parts.items()]
    )


def stored_trees(spark: SparkSession, path: str) -> tuple[list[dict[int, Row]], list[float]]:
    """Nodes by number and weight of every tree of a stored tree model; as large as the model."""
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" not in data.columns:  # a single tree
        return [{r["id"]: r for r in data.collect()}], [1.0]
    trees: dict[int, dict[int, Row]] = {}
    for r in data.select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    weights = dict(spark.read.parquet(f"{path}/treesMetadata").select("_1", "_3").collect())
    return [trees[t] for t in sorted(trees)], [float(weights[t]) for t in sorted(trees)]


def _paths(nodes: Mapping[int, Row], value: Callable[[Row], float], source_of: Sequence[int], sources: int) -> list[list[float]]:
    """Per leaf, in the order in which leaves are met from the left, what each source adds along its path."""
    out, stack = [], [(0, [0.0] * sources)]
    while stack:
        number, added = stack.pop()
        node = nodes[number]
        if node["leftChild"] < 0:
            out.append(added)
            continue
        for child in (node["rightChild"], node["leftChild"]):
            step = list(added)
            step[source_of[node["split"]["featureIndex"]]] += value(nodes[child]) - value(node)
            stack.append((child, step))
    return out


def tree_contributions(fitted: Fitted, df: DataFrame, keep: Sequence[str], path: str | None = None) -> DataFrame:
    """Per row: path attribution of each source feature, base value and margin of a tree model.

    A split adds to its feature what the row's side of it changes in the node's mean, so base and contributions add
    up to the margin exactly: the positive share of a tree, its mean over a forest, the weighted sum of boosted trees.
    Leaves come from the model; what their paths add is looked up in a table inside the row, without a shuffle.
    ``path`` is where the model is stored; without it the model is written to the checkpoint folder first.
    """
    spark, prep, name = df.sparkSession, fitted.preparation, fitted.name
    if name not in ("decision_tree", "random_forest", "gradient_boosted"):
        raise ContractError("Path attribution needs a tree model")
    if path is None:
        path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
        fitted.model.write().save(path)
    trees, weights = stored_trees(spark, path)
    if name == "random_forest":
        weights = [1.0 / len(trees)] * len(trees)
    names, origins = prep.names(), prep.origins()
    sources = list(dict.fromkeys(origins[n] for n in names))
    source_of = [sources.index(origins[n]) for n in names]

    def value(node: Row) -> float:
        return node["prediction"] if name == "gradient_boosted" else node["impurityStats"][1] / sum(node["impurityStats"])

    table = [
        [[weight * v for v in leaf] for leaf in _paths(nodes, value, source_of, len(sources))]
        for nodes, weight in zip(trees, weights, strict=True)
    ]
    base = sum(weight * value(nodes[0]) for nodes, weight in zip(trees, weights, strict=True))
    model = fitted.model.copy()
    model.setLeafCol("_leaf")
    scored = model.transform(fitted.vectors(df, keep))
    leaf = F.col("_leaf")
    leaves = F.array(leaf) if len(trees) == 1 and scored.schema["_leaf"].dataType.simpleString() == "double" else vector_to_array("_leaf")
    lookup = F.from_json(F.lit(json.dumps(table)), "array<array<array<double>>>")
    parts = F.zip_with(lookup, leaves, lambda tree, at: F.get(tree, at.cast("int")))
    total = F.aggregate(parts, F.array(*[F.lit(0.0)] * len(sources)), lambda t, part: F.zip_with(t, part, lambda a, b: a + b))
    if name == "gradient_boosted":
        margin = vector_to_array("rawPrediction")[1]
    else:
        margin = vector_to_array("probability")[1]
    added = scored.select(*keep, margin.alias("margin"), total.alias("_parts"))
    return added.select(*keep, F.lit(base).alias("base_value"), "margin", *[F.col("_parts")[i].alias(f"c_{s}") for i, s in enumerate(sources)])


def _sources(contributions: DataFrame) -> list[str]:
    return [c[2:] for c in contributions.columns if c.startswith("c_")]


def additivity_error(contributions: DataFrame) -> DataFrame:
    """Largest gap between base plus contributions and the model margin."""
    total = F.col("base_value")
    for s in _sources(contributions):
        total = total + F.col(f"c_{s}")
    return contributions.agg(F.max(F.abs(total - F.col("margin"))).alias("max_additivity_error"))


def global_importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per source feature."""
    names = _sources(contributions)
    wide = contributions.agg(*[F.avg(F.abs(f"c_{s}")).alias(s) for s in names])
    return long_rows(wide, [{"feature": F.lit(s), "mean_absolute_contribution": F.col(s)} for s in names])


def top_contributions(contributions: DataFrame, keep: Sequence[str], top: int = TOP) -> DataFrame:
    """Strongest increases and reductions of each row, sorted inside the row; no shuffle."""
    names = _sources(contributions)
    items = F.array(*[F.struct(F.col(f"c_{s}").alias("contribution"), F.lit(s).alias("feature"),
                               F.initcap(F.lit(s.replace("_", " "))).alias("label")) for s in names])
    up = F.slice(F.sort_array(F.filter(items, lambda x: x["contribution"] > 0), asc=False), 1, top)
    down = F.slice(F.sort_array(F.filter(items, lambda x: x["contribution"] < 0)), 1, top)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x["contribution"])

    size = F.aggregate(items, F.lit(0.0), lambda a, x: a + F.abs(x["contribution"]))
    return contributions.select(
        *keep, "base_value", up.alias("increases_risk"), down.alias("reduces_risk"),
        (total(items) - total(up) - total(down)).alias("remainder"), size.alias("absolute_total"),
    )


def permutation_importance(fitted: Fitted, df: DataFrame, features: Sequence[str], shift: int = 1) -> DataFrame:
    """Drop in ROC-AUC when one feature is permuted.

    Rows are ranked by the hash of their id once; a permuted value comes from the
    row ``shift`` places further on, through one join.  All variants are scored
    as narrow branches and measured in one grouped pass.  Every feature is reported; the table with the permuted
    columns is stored, not cached.
    """
    ordered = ranked(df.withColumn("_h", hash_order("id")), ["_h", "id"]).drop("_h")
    moved = ordered.select(
        ((F.col("rank") + shift) % F.col("rank_total")).alias("rank"), *[F.col(f).alias(f"_p_{f}") for f in features]
    )
    wide = ordered.drop("rank_total").join(moved, "rank").checkpoint()
    variants = [wide.withColumn("feature", F.lit("(none)"))]
    variants += [wide.withColumn(f, F.col(f"_p_{f}")).withColumn("feature", F.lit(f)) for f in features]
    scored = None
    for v in variants:
        part = fitted.score(v, ["feature", "y"], "p")
        scored = part if scored is None else scored.unionByName(part)
    aucs = rank_metrics(scored, groups=["feature"]).select("feature", "roc_auc", (F.col("positives") + F.col("negatives")).alias("n_rows"))
    full = aucs.where("feature = '(none)'").first()["roc_auc"]
    out = aucs.where("feature <> '(none)'").withColumn("auc_drop", F.lit(full) - F.col("roc_auc"))
    return out.orderBy(F.desc("auc_drop"), "feature")
