"""Policy reports: what a report service answered per URL, as one envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import parse_whole
from ..operators.once import computed_once
from ..schemas import POLICY_BODY, POLICY_REPORTS, REPORT_DATA

TIMEOUT_SECONDS = 240
TIMEOUT = "timeout"


def read_policy_reports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(POLICY_REPORTS).format(fmt).load(path)


def report_envelopes(reports: DataFrame) -> DataFrame:
    """One envelope per URL: ``ok``, ``status_code``, ``error``, ``raw_response``, ``report``.

    Of several answers for a URL, one with status 200 and a readable body comes first, then
    any answer before none, then the newest by ``fetched_at`` where the table has it.

    Fields of the same name inside the body win over the envelope's own.
    ``report`` is the body's ``data`` object when it has one, else the body's own
    fields; bodies are parsed once per URL, before any join. ``content`` is the whole body as
    VARIANT, with the keys that the report's fixed fields do not name; null where unreadable.
    """
    failed = F.col("transport_error").isNotNull()
    newest = F.col("fetched_at") if "fetched_at" in reports.columns else F.lit(0)
    read = computed_once(
        reports.withColumn("_b", F.when(~failed, parse_whole(F.trim("body"), POLICY_BODY))), "_b"
    )
    rank = F.when(F.col("_b").isNotNull() & (F.col("status_code") == 200), 2).when(failed, 0).otherwise(1)
    answer = F.struct("status_code", "body", "transport_error")
    parsed = read.groupBy("url").agg(
        F.max_by(
            F.struct("status_code", "body", "transport_error", "_b"),
            F.struct(rank.alias("rank"), newest.alias("at"), answer.alias("answer")),
        ).alias("_r")
    ).select("url", "_r.*")
    body = F.col("_b")
    readable = body.isNotNull()
    fine = readable & (F.col("status_code") == 200)
    own_fields = F.when(readable, F.struct(*[body[n].alias(n) for n in REPORT_DATA.names]))
    return parsed.select(
        "url",
        F.coalesce(body["ok"], fine, F.lit(False)).alias("ok"),
        F.when(~failed, F.coalesce(body["statusCode"], F.col("status_code"))).alias("status_code"),
        F.when(failed, _transport_text(F.col("transport_error")))
        .when(~readable, F.lit("Failed to parse policy report response"))
        .when(fine, body["error"])
        .otherwise(F.coalesce(
            body["error"],
            F.concat(
                F.lit("Policy report service returned HTTP "),
                F.col("status_code").cast("string"),
            ),
        )).alias("error"),
        F.when(failed, F.lit(None))
        .when(fine, body["rawResponse"])
        .otherwise(F.coalesce(body["rawResponse"], F.col("body"))).alias("raw_response"),
        F.coalesce(body["data"], own_fields).alias("report"),
        F.when(readable, F.try_parse_json(F.trim("body"))).alias("content"),
    )


def _transport_text(error: Column) -> Column:
    return F.when(
        error == TIMEOUT,
        F.lit(f"Policy report request timed out after {TIMEOUT_SECONDS} seconds"),
    ).otherwise(F.concat(F.lit("Policy report request failed: "), error))
