"""Idle and orphaned resources in inventory snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Idle threshold, prices and severities.
IDLE_HOURS = 24
STORAGE_USD_PER_GI = 0.10
REPLICA_USD = 30
MIN_REPLICAS, FREE_REPLICAS = 3, 2
SEVERITIES = ("high", "medium", "low", "info")

# Fixed values: (type, severity, recommendation) of every kind of finding.
IDLE_POD = ("idle_pod", "low", "Review if pod is still needed or scale down")
OVERPROVISIONED = (
    "overprovisioned_deployment",
    "medium",
    "Consider reducing replicas if traffic is low",
)
ORPHANED_VOLUME = (
    "orphaned_volume",
    "high",
    "Delete if no longer needed to reduce storage costs",
)
NO_ENDPOINTS = (
    "service_no_endpoints",
    "medium",
    "Service has no backends - verify configuration",
)
REVIEW_SERVICE = (
    "inference_service_review",
    "info",
    "Review traffic metrics to determine if service is utilized",
)

# Gi per unit, used when all units are asked for.
_GI_PER_UNIT = {"Ki": 2.0**-20, "Mi": 2.0**-10, "Gi": 1.0, "Ti": 2.0**10}


def _finding(finding: tuple[str, str, str], resource: Column, **details: Column) -> list:
    kind, severity, advice = finding
    given = {
        "age_hours": F.lit(None).cast("double"),
        "replicas": F.lit(None).cast("long"),
        "storage": F.lit(None).cast("string"),
        **details,
    }
    return [
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        resource.alias("resource"),
        *[c.alias(n) for n, c in given.items()],
        F.lit(advice).alias("recommendation"),
    ]


def _named() -> Column:
    return F.concat_ws("/", "namespace", "name")


def idle_pods(pods: DataFrame, as_of: Column, hours: float = IDLE_HOURS) -> DataFrame:
    """Running pods without restarts whose last condition change is too old.

    Pods have ``phase``, ``conditions`` (array of struct with
    ``last_transition``) and ``containers`` (array of struct with ``restarts``).
    """
    last = F.array_max(F.transform("conditions", lambda c: c["last_transition"]))
    restarts = F.aggregate(
        F.coalesce(
            F.transform("containers", lambda c: c["restarts"].cast("long")),
            F.array().cast("array<bigint>"),
        ),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    age = (F.unix_micros(as_of) - F.unix_micros(last)) / F.lit(3_600_000_000.0)
    idle = pods.filter((F.col("phase") == "Running") & (restarts == 0) & (age > hours))
    return idle.select(
        *_finding(IDLE_POD, _named(), age_hours=age)
    )


def overprovisioned(deployments: DataFrame, namespaces: Sequence[str] | None = None) -> DataFrame:
    """Deployments with three or more replicas, all ready."""
    wanted = F.when(F.coalesce("replicas", F.lit(0)) == 0, 1).otherwise(F.col("replicas"))
    ready = F.coalesce("ready_replicas", F.lit(0))
    df = deployments if namespaces is None else deployments.filter(F.col("namespace").isin(*namespaces))
    return df.filter((wanted >= MIN_REPLICAS) & (ready == wanted)).select(
        *_finding(OVERPROVISIONED, _named(), replicas=wanted.cast("long"))
    )


def orphaned_volumes(claims: DataFrame, pods: DataFrame) -> DataFrame:
    """Volume claims that no pod mounts. Pods have ``claims``, the names they mount."""
    # distinct() first: a claim mounted by a third of all pods is one row here.
    used = pods.select("namespace", F.explode("claims").alias("name")).distinct()
    return claims.join(used, ["namespace", "name"], "left_anti").select(
        *_finding(ORPHANED_VOLUME, _named(), storage=F.col("storage"))
    )


def services_without_endpoints(
    services: DataFrame, endpoints: DataFrame, namespaces: Sequence[str] | None = None
) -> DataFrame:
    df = services if namespaces is None else services.filter(F.col("namespace").isin(*namespaces))
    known = endpoints.select("namespace", "name").distinct()
    return df.join(known, ["namespace", "name"], "left_anti").select(
        *_finding(NO_ENDPOINTS, _named())
    )


def ready_services(services: DataFrame) -> DataFrame:
    """Inference services with a true Ready condition, to be reviewed for traffic."""
    ready = F.exists("conditions", lambda c: (c["type"] == "Ready") & (c["status"] == "True"))
    return services.filter(F.coalesce(ready, F.lit(False))).select(
        *_finding(REVIEW_SERVICE, _named())
    )


def findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def severity_counts(found: DataFrame) -> DataFrame:
    """Findings per severity, zeros included."""
    counts = [
        F.struct(F.lit(s).alias("severity"), F.count_if(F.col("severity") == s).alias("findings"))
        for s in SEVERITIES
    ]
    return found.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def storage_gi(quantity: Column, all_units: bool = False) -> Column:
    """Whole Gi of a quantity such as ``10Gi``; other units count 0 unless asked for."""
    if not all_units:
        digits = F.regexp_extract(quantity, r"^(\d+)Gi$", 1)
        return F.coalesce(digits.try_cast("double"), F.lit(0.0))
    number = F.regexp_extract(quantity, r"^([\d.]+)(Ki|Mi|Gi|Ti)$", 1).try_cast("double")
    unit = F.regexp_extract(quantity, r"^([\d.]+)(Ki|Mi|Gi|Ti)$", 2)
    factor = F.lit(None).cast("double")
    for name, gi in _GI_PER_UNIT.items():
        factor = F.when(unit == name, F.lit(gi)).otherwise(factor)
    return F.coalesce(number * factor, F.lit(0.0))


def savings(found: DataFrame, all_units: bool = False) -> DataFrame:
    """Estimated monthly savings in dollars, rounded to cents."""
    storage = F.when(
        F.col("type") == ORPHANED_VOLUME[0],
        storage_gi(F.col("storage"), all_units) * STORAGE_USD_PER_GI,
    )
    replicas = F.when(
        (F.col("type") == OVERPROVISIONED[0]) & (F.col("replicas") > FREE_REPLICAS),
        (F.col("replicas") - FREE_REPLICAS) * float(REPLICA_USD),
    )
    total = F.sum(F.coalesce(storage, replicas, F.lit(0.0)))
    return found.agg(F.round(F.coalesce(total, F.lit(0.0)), 2).alias("monthly_savings_usd"))
