"""Keyed JSON messages: stream and batch sources, decoding and validation.

Every message becomes either a valid row or a quarantined row with a reason; none is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.config import ANOMALY_TYPES, METRICS, SEVERITIES
from fleetpulse.schemas import MESSAGE, RAW_ALERT, RAW_TELEMETRY

# Topic names.
TOPICS = {"telemetry": "telemetry.raw", "alerts": "alerts.triggered"}


# Limits of one micro-batch.
MAX_OFFSETS = 1_000_000
MAX_FILES = 1000


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """key, value (text) and timestamp of a topic from its earliest offset.

    Needs Spark's Kafka connector on the classpath. Progress is kept in the query's
    checkpoint, so a message is not skipped when its batch fails. A batch takes a limited number
    of messages, the first one too; pass maxOffsetsPerTrigger for another limit.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    for name, value in ({"maxOffsetsPerTrigger": MAX_OFFSETS} | options).items():
        reader = reader.option(name, value)
    return reader.load().selectExpr(
        "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "timestamp"
    )


def kafka_publish(encoded: DataFrame, servers: str, topic: str) -> None:
    """Send encoded messages; the key decides the topic partition, so a host stays in order."""
    encoded.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def stream_sink(
    encoded: DataFrame, checkpoint: str, path: str | None = None, servers: str | None = None, topic: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write a stream of encoded messages to files, each once, or to a topic, each at least once."""
    writer = encoded.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    if path is not None:
        return writer.format("parquet").option("path", path).start()
    if servers is None or topic is None:
        raise ValueError("a sink needs a path, or servers and a topic")
    return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()


def file_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int = MAX_FILES
) -> DataFrame:
    """The same messages from files with the columns key and value, a limited number of files a batch."""
    reader = spark.readStream.format(fmt).schema(MESSAGE).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def encode(rows: DataFrame, key: str = "host_id") -> DataFrame:
    """One keyed JSON message per row; nulls are written out."""
    body = F.struct(*rows.columns)
    return rows.select(
        F.col(key).alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")
    )


def encode_telemetry(telemetry: DataFrame) -> DataFrame:
    """Telemetry rows as messages of the input contract."""
    shaped = telemetry.selectExpr(
        "CAST(event_id AS STRING) AS event_id",
        "host_id",
        "service_name",
        "ts AS timestamp",
        f"named_struct({', '.join(f"'{m}', {m}" for m in METRICS)}) AS metrics",
        """named_struct('active', injected_anomaly_type IS NOT NULL, 'type', injected_anomaly_type)
            AS injected_anomaly""",
    )
    return encode(shaped)


def _parse(messages: DataFrame, schema) -> DataFrame:
    """Add the parsed message as _m.

    The explode of a single element keeps the optimizer from copying the parser into every
    later filter and column that reads a field of it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return messages.select("*", F.explode(F.array(F.from_json("value", schema, options))).alias("_m"))


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _first_problem(problems: dict[str, str]) -> str:
    """SQL giving the name of the first condition that holds, else null."""
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for name, c in problems.items()) + " END"


def _time(field: str) -> str:
    """SQL: a time given as text or as epoch number, null if it is neither or beyond the year 9999.

    Numbers beyond 2e10 are milliseconds, as in the message contract.
    """
    number = f"try_cast({field} AS DOUBLE)"
    seconds = f"(CASE WHEN abs({number}) > 2e10D THEN {number} / 1000D ELSE {number} END)"
    return f"""CASE WHEN {number} IS NULL THEN try_cast({field} AS TIMESTAMP)
        WHEN abs({seconds}) <= 253402300799D THEN timestamp_seconds({seconds}) END"""


def _numbers(prefix: str, names: tuple[str, ...]) -> str:
    """Condition: some of these text fields is missing or not a number."""
    return " OR ".join(f"try_cast({prefix}{n} AS DOUBLE) IS NULL" for n in names)


def check_telemetry(messages: DataFrame) -> DataFrame:
    """Telemetry columns plus reject_reason (null for valid messages).

    Numeric text is accepted for numbers. A missing injected_anomaly means none, a missing
    timestamp takes the arrival time, and a missing event_id is derived from the message, so
    that reading it again gives the same id. Unknown fields are ignored.
    """
    arrival = "timestamp" if "timestamp" in messages.columns else "current_timestamp()"
    problems = {
        "malformed_json": "_m IS NULL OR _m._corrupt IS NOT NULL",
        "missing_host_id": "_m.host_id IS NULL",
        "missing_service_name": "_m.service_name IS NULL",
        "bad_metric": _numbers("_m.metrics.", METRICS),
        "bad_timestamp": "_m.timestamp IS NOT NULL AND _time IS NULL",
        "bad_injected_anomaly": f"""(_m.injected_anomaly.active IS NOT NULL
            AND try_cast(_m.injected_anomaly.active AS BOOLEAN) IS NULL)
            OR _m.injected_anomaly.type NOT IN ({_quoted(ANOMALY_TYPES)})""",
    }
    parsed = _parse(messages, RAW_TELEMETRY).selectExpr(
        "*",
        f"{arrival} AS _arrival",
        f"{_time('_m.timestamp')} AS _time",
    )
    return parsed.selectExpr(
        "key",
        "value",
        "coalesce(_m.event_id, md5(concat_ws('|', key, value))) AS event_id",
        "_m.host_id AS host_id",
        "_m.service_name AS service_name",
        "coalesce(_time, _arrival) AS ts",
        *[f"try_cast(_m.metrics.{m} AS DOUBLE) AS {m}" for m in METRICS],
        """named_struct('active', coalesce(try_cast(_m.injected_anomaly.active AS BOOLEAN), false),
            'type', _m.injected_anomaly.type) AS injected_anomaly""",
        f"{_first_problem(problems)} AS reject_reason",
    )


def check_alerts(messages: DataFrame) -> DataFrame:
    """Alert columns plus reject_reason (null for valid messages)."""
    snapshot = ", ".join(f"'{m}', try_cast(_m.metric_snapshot.{m} AS DOUBLE)" for m in METRICS)
    recent = ", ".join(f"'{m}', try_cast(r.{m} AS DOUBLE)" for m in METRICS)
    arrival = "timestamp" if "timestamp" in messages.columns else "current_timestamp()"
    problems = {
        "malformed_json": "_m IS NULL OR _m._corrupt IS NOT NULL",
        "missing_host_id": "_m.host_id IS NULL",
        "missing_service_name": "_m.service_name IS NULL",
        "bad_score": _numbers("_m.", ("raw_score", "threshold", "ewma_mean", "ewma_std")),
        "bad_severity": f"_m.severity IS NULL OR _m.severity NOT IN ({_quoted(SEVERITIES)})",
        "bad_metric": _numbers("_m.metric_snapshot.", METRICS)
        + f" OR exists(_m.recent_metrics, r -> {_numbers('r.', METRICS)})",
        "bad_timestamp": f"_m.triggered_at IS NOT NULL AND ({_time('_m.triggered_at')}) IS NULL",
        "bad_forecast": """_m.predicted_breach_minutes IS NOT NULL
            AND try_cast(_m.predicted_breach_minutes AS DOUBLE) IS NULL""",
    }
    return _parse(messages, RAW_ALERT).selectExpr(
        "key",
        "value",
        "coalesce(_m.alert_id, md5(concat_ws('|', key, value))) AS alert_id",
        "_m.event_id AS event_id",
        "try_cast(_m.n AS BIGINT) AS n",
        "_m.host_id AS host_id",
        "_m.service_name AS service_name",
        f"coalesce({_time('_m.triggered_at')}, {arrival}) AS triggered_at",
        *[
            f"try_cast(_m.{c} AS DOUBLE) AS {c}"
            for c in ("raw_score", "threshold", "ewma_mean", "ewma_std")
        ],
        "_m.severity AS severity",
        f"named_struct({snapshot}) AS metric_snapshot",
        f"""transform(coalesce(_m.recent_metrics, array()), r -> named_struct({recent}))
            AS recent_metrics""",
        "coalesce(try_cast(_m.is_early_warning AS BOOLEAN), false) AS is_early_warning",
        "try_cast(_m.predicted_breach_minutes AS DOUBLE) AS predicted_breach_minutes",
        f"{_first_problem(problems)} AS reject_reason",
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason IS NULL").drop("key", "value", "reject_reason")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason IS NOT NULL").select("key", "value", "reject_reason")


def decode_telemetry(messages: DataFrame) -> DataFrame:
    """Valid telemetry rows, in the shape the detection operators read."""
    return valid(check_telemetry(messages)).selectExpr(
        "* EXCEPT (injected_anomaly)",
        "CASE WHEN injected_anomaly.active THEN injected_anomaly.type END AS injected_anomaly_type",
    )


def decode_alerts(messages: DataFrame) -> DataFrame:
    return valid(check_alerts(messages))
