"""Model lifecycle: warm-up, versions, sliding training sets, forest fit and scores.

With n the event's number within its host, version and training set have closed forms, so
retraining needs no running state:

* version v is fitted at event P(v) = warmup + retrain * (v - 1), on the last `train_window`
  events up to and including it (version 1 has only the warm-up events);
* events P(v) .. P(v+1) - 1 are scored by version v, except event P(1), the last warm-up one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.config import DETECTOR, FEATURES, LAYOUT, DetectorConfig, LayoutConfig
from fleetpulse.functions.forest import Forest, fit_forest, node_count, pack_forest, score_forest, unpack_forest
from fleetpulse.operators.series import spread

GROUP = ("host_id", "model_version")

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("host_id", T.StringType()),
        T.StructField("model_version", T.IntegerType()),
        T.StructField("n_train", T.IntegerType()),
        T.StructField("subsample", T.IntegerType()),
        T.StructField("n_trees", T.IntegerType()),
        T.StructField("feature", T.ArrayType(T.ShortType())),
        T.StructField("threshold", T.ArrayType(T.DoubleType())),
        T.StructField("size", T.ArrayType(T.IntegerType())),
    ]
)

# the same forests without the unused places of their trees, see `pack_forest`: a ninth of the bytes, and no list to take apart
PACKED_SCHEMA = T.StructType(
    [*MODEL_SCHEMA.fields[:5], *[T.StructField(c, T.BinaryType()) for c in ("splits", "feature", "threshold", "size")]]
)


def version_of(config: DetectorConfig = DETECTOR) -> str:
    """Version that scores event n; null during warm-up."""
    warmup, step = config.warmup_events, config.retrain_interval
    return f"CASE WHEN n > {warmup} THEN CAST(1 + (n - {warmup}) div {step} AS INT) END"


def trained_versions(config: DetectorConfig = DETECTOR) -> str:
    """Array of all versions whose training set holds event n; short for any series length."""
    warmup, step = config.warmup_events, config.retrain_interval
    first = f"CAST(greatest(1, ceil((n - {warmup}) / {step}) + 1) AS INT)"
    last = f"CAST(floor((n + {config.train_window - warmup - 1}) / {step}) + 1 AS INT)"
    return f"CASE WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE CAST(array() AS ARRAY<INT>) END"


def score_from_column(
    numbered: DataFrame, score_col: str, config: DetectorConfig = DETECTOR
) -> DataFrame:
    """Use an existing column as the score, with the same warm-up rule and versions."""
    return numbered.selectExpr(
        "*",
        f"CASE WHEN n > {config.warmup_events} THEN CAST({score_col} AS DOUBLE) END AS raw_score",
        f"{version_of(config)} AS model_version",
    )


def training_rows(events: DataFrame, config: DetectorConfig = DETECTOR) -> DataFrame:
    """One row per event and version it trains; versions that are never reached included."""
    return events.selectExpr("*", f"explode({trained_versions(config)}) AS model_version")


def training_sets(events: DataFrame, config: DetectorConfig = DETECTOR) -> DataFrame:
    """Size and span of each version's training set.

    A version exists once its fitting event does, which is the last row of its own set.
    """
    rows = training_rows(events.select("host_id", "n"), config)
    fitted_at = f"{config.warmup_events} + (model_version - 1L) * {config.retrain_interval}"
    return (
        rows.groupBy(*GROUP)
        .agg(
            F.count("*").alias("n_train"),
            F.min("n").alias("first_event"),
            F.max("n").alias("last_event"),
        )
        .filter(f"last_event = {fitted_at}")
    )


def _matrix(table: pa.Table) -> np.ndarray:
    return np.column_stack([table[f].to_numpy() for f in FEATURES]).astype(np.float64)


def _fit(x: np.ndarray, config: DetectorConfig) -> Forest:
    return fit_forest(x, config.n_trees, config.subsample, config.seed)


def fit_models(
    featured: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT, packed: bool = False
) -> DataFrame:
    """One forest per (host, version) as flat arrays; packed, in the form that a model table is stored and sent in.

    Groups hold at most `train_window` rows. Scoring a whole history does not go through this table,
    since a forest is far larger than the events it scores, see `score_events`; scoring new events of
    known versions does, see `score_with_models`.
    """
    schema, arrow = (PACKED_SCHEMA, _PACKED_ARROW) if packed else (MODEL_SCHEMA, _MODEL_ARROW)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        host, version = key[0].as_py(), key[1].as_py()
        table = table.sort_by("n")
        fitting_event = config.warmup_events + (version - 1) * config.retrain_interval
        if table["n"][-1].as_py() != fitting_event:
            return arrow.empty_table()
        forest = _fit(_matrix(table), config)
        about = {
            "host_id": host,
            "model_version": version,
            "n_train": table.num_rows,
            "subsample": forest.subsample,
            "n_trees": config.n_trees,
        }
        nodes = pack_forest(forest) if packed else {c: getattr(forest, c).ravel() for c in ("feature", "threshold", "size")}
        return pa.table({c: [value] for c, value in (about | nodes).items()}, schema=arrow)

    rows = training_rows(featured.select("host_id", "n", *FEATURES), config)
    return spread(rows, layout, *GROUP).groupBy(*GROUP).applyInArrow(fit, schema)


def block_rows(config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT) -> int:
    """How many forests a row group of a stored model table holds, as a reader decodes a whole one at once."""
    return max(1, layout.model_block_nodes // (config.n_trees * node_count(config.subsample)))


_MODEL_ARROW = pa.schema(
    [
        ("host_id", pa.string()),
        ("model_version", pa.int32()),
        ("n_train", pa.int32()),
        ("subsample", pa.int32()),
        ("n_trees", pa.int32()),
        ("feature", pa.list_(pa.int16())),
        ("threshold", pa.list_(pa.float64())),
        ("size", pa.list_(pa.int32())),
    ]
)
_PACKED_ARROW = pa.schema([*list(_MODEL_ARROW)[:5], *[(c, pa.binary()) for c in ("splits", "feature", "threshold", "size")]])


def scoring_blocks(featured: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT) -> DataFrame:
    """Blocks of successive versions: the events they score, and those before that train them.

    An event is in its own block as itself. Only the last `train_window` events before a block are also in it, as
    copies that carry features only; with the default of eight versions a block these are a quarter of all events.
    """
    payload = [c for c in featured.columns if c not in ("host_id", "n", *FEATURES)]
    # version 0 collects the warm-up events, which no model scores
    span = max(1, layout.scoring_rows // config.retrain_interval)
    return featured.selectExpr(
        "*", f"{version_of(config)} AS model_version", f"CAST(coalesce({version_of(config)}, 0) div {span} AS INT) AS _own"
    ).selectExpr(
        "* EXCEPT (_own)",
        f"""inline(concat(
            array(named_struct('_block', _own, '_trains', false)),
            transform(array_except(transform({trained_versions(config)}, v -> CAST(v div {span} AS INT)), array(_own)),
                b -> named_struct('_block', b, '_trains', true)))) """,
    ).selectExpr(
        "host_id",
        "n",
        *FEATURES,
        *[f"CASE WHEN NOT _trains THEN {c} END AS {c}" for c in payload],
        "model_version",
        "_block",
        "_trains",
    )


def score_events(
    featured: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """Add raw_score and model_version to every event; null for warm-up events.

    Each block of `scoring_blocks` is one group, so a forest is fitted and used in the same task and is never written or
    shuffled.
    """
    scored_schema = T.StructType(
        [f for f in featured.schema.fields]
        + [T.StructField("model_version", T.IntegerType()), T.StructField("raw_score", T.DoubleType())]
    )

    def score(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        own = ~table["_trains"].to_numpy()
        n, x = table["n"].to_numpy(), _matrix(table)
        versions = np.where(own, table["model_version"].fill_null(0).to_numpy(), 0)
        scores = np.full(len(n), np.nan)
        for version in np.unique(versions[versions > 0]):
            fitted_at = config.warmup_events + (int(version) - 1) * config.retrain_interval
            first, last = np.searchsorted(n, [fitted_at - config.train_window, fitted_at], side="right")
            due = np.flatnonzero(versions == version)
            scores[due] = score_forest(_fit(x[first:last], config), x[due])
        table = table.append_column("raw_score", pa.array(scores, mask=versions == 0))
        return table.filter(pa.array(own)).select(scored_schema.names)

    return spread(scoring_blocks(featured, config, layout), layout, "host_id", "_block").groupBy("host_id", "_block").applyInArrow(score, scored_schema)


def score_with_models(
    featured: DataFrame, models: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """Add raw_score and model_version from the table that `fit_models` gave, packed or not, without a fit.

    A version meets the events that it scores, `retrain_interval` of a host at most, in one group of a cogroup; only
    models that some event needs reach it, and warm-up events are left out of it. Events whose
    model is not in the table get their version and no score. Pass new events only, with their features and numbers.
    """
    versioned = featured.selectExpr("*", f"{version_of(config)} AS model_version")
    schema = T.StructType([*versioned.schema.fields, T.StructField("raw_score", T.DoubleType())])
    due = versioned.filter("model_version IS NOT NULL")
    # dealt out like the groups below: a join that is not broadcast then sends and sorts the models as the cogroup needs them
    wanted = spread(due.select(*GROUP).distinct(), layout, *GROUP)
    packed = "splits" in models.columns
    own = models.join(wanted, list(GROUP), "left_semi").select((PACKED_SCHEMA if packed else MODEL_SCHEMA).names)

    def forest_of(row: pa.Table) -> Forest:
        trees, subsample = row["n_trees"][0].as_py(), row["subsample"][0].as_py()
        if packed:
            return unpack_forest({c: row[c][0].as_py() for c in ("splits", "feature", "threshold", "size")}, trees, subsample)
        arrays = [row[c].combine_chunks().flatten().to_numpy().reshape(trees, -1) for c in ("feature", "threshold", "size")]
        return Forest(*arrays, subsample)

    def score(key: tuple, events: pa.Table, model: pa.Table) -> pa.Table:
        if not model.num_rows or not events.num_rows:
            scores = pa.nulls(events.num_rows, pa.float64())
        else:
            scores = pa.array(score_forest(forest_of(model.slice(0, 1)), _matrix(events)))
        return events.append_column("raw_score", scores).select(schema.names)

    groups = [spread(side, layout, *GROUP).groupBy(*GROUP) for side in (due, own)]
    scored = groups[0].cogroup(groups[1]).applyInArrow(score, schema)
    return scored.unionByName(versioned.filter("model_version IS NULL").withColumn("raw_score", F.lit(None).cast("double")))


# Ground-truth label of a decoded message: the type if one was injected, else null.
LABEL = "CASE WHEN injected_anomaly.active THEN injected_anomaly.type END"
