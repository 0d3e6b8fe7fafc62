"""Query registration and the shared SQL building blocks of the counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; without ``sql`` it is checked by tests only."""

    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, **exceptions: int) -> DataFrame:
    """Round every double column so that summation order does not show."""

    def cell(name: str, kind: str) -> Column:
        if kind != "double":
            return F.col(name)
        # Adding 0.0 turns a negative zero into zero.
        return (F.round(name, exceptions.get(name, digits)) + F.lit(0.0)).alias(name)

    return df.select(*(cell(name, kind) for name, kind in df.dtypes))


# Named SQL steps: (steps it reads, text). ``steps`` puts the needed ones in a WITH clause.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def step(name: str, reads: tuple[str, ...], text: str) -> None:
    STEPS[name] = (reads, text)


def steps(*names: str) -> str:
    """WITH clause holding the named steps and everything they read, in reading order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for source in STEPS[name][0]:
            visit(source)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS (\n{STEPS[name][1]}\n)" for name in ordered) + "\n"


step(
    "policy",
    (),
    """SELECT o_orderkey AS IDpol, CAST(o_orderkey % 5 AS INTEGER) AS ClaimNb,
       CASE WHEN c_nationkey = 13 THEN 0e0
            ELSE CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-02') AS DOUBLE) / 365e0
       END AS Exposure,
       c_nationkey AS VehPower, CAST(2001 - year(o_orderdate) AS INTEGER) AS VehAge,
       CAST(18 + o_custkey % 60 AS INTEGER) AS DrivAge,
       CAST(50 + (o_custkey * 7) % 150 AS INTEGER) AS BonusMalus,
       c_mktsegment AS VehBrand, o_orderstatus AS VehGas, o_orderpriority AS Area,
       o_totalprice / 50e0 AS Density, r_name AS Region, c_nationkey AS pool_id
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus <> 'P'""",
)
step(
    "claim",
    (),
    """SELECT l_orderkey AS IDpol, l_extendedprice * (1e0 - l_discount) AS ClaimAmount
FROM lineitem WHERE l_returnflag = 'R'""",
)
step(
    "reconciled",
    ("policy", "claim"),
    """SELECT p.*, coalesce(o.n, 0) AS observed
FROM policy p LEFT JOIN (SELECT IDpol, count(*) AS n FROM claim GROUP BY IDpol) o ON p.IDpol = o.IDpol""",
)
step(
    "cleaned",
    ("reconciled",),
    """SELECT IDpol, CAST(CASE WHEN observed > 4 THEN 4 ELSE observed END AS BIGINT) AS ClaimNb,
       ClaimNb AS ClaimNb_declared, CASE WHEN Exposure > 1e0 THEN 1e0 ELSE Exposure END AS Exposure,
       VehPower, VehAge, DrivAge, BonusMalus, VehBrand, VehGas, Area, Density, Region, pool_id
FROM reconciled""",
)


def band_sql(value: str, edges: list[float], labels: list[str]) -> str:
    cases = " ".join(f"WHEN {value} <= {upper} THEN '{label}'" for upper, label in zip(edges[1:], labels))
    return f"CASE WHEN {value} IS NULL OR {value} < {edges[0]} THEN NULL {cases} ELSE '{labels[-1]}' END"


# Lower edges and labels of the bands.
VEH_AGE = ([0, 2, 5, 10], ["0-2", "3-5", "6-10", "11+"])
DRIV_AGE = ([0, 25, 35, 50, 65], ["0-25", "26-35", "36-50", "51-65", "66+"])
BONUS = ([0, 50, 75, 100, 150], ["0-50", "51-75", "76-100", "101-150", "151+"])
DENSITY = ([0, 100, 500, 1500, 5000], ["0-100", "101-500", "501-1500", "1501-5000", "5001+"])

step(
    "derived",
    ("cleaned",),
    f"""SELECT *, ln(1e0 + Density) AS Density_log1p,
       {band_sql('VehAge', *VEH_AGE)} AS VehAge_band,
       {band_sql('DrivAge', *DRIV_AGE)} AS DrivAge_band,
       {band_sql('BonusMalus', *BONUS)} AS BonusMalus_band,
       {band_sql('Density', *DENSITY)} AS Density_band
FROM cleaned""",
)
step(
    "severity",
    ("claim",),
    "SELECT IDpol, sum(ClaimAmount) AS total, avg(ClaimAmount) AS mean FROM claim GROUP BY IDpol",
)
step(
    "modelling",
    ("derived", "severity"),
    """SELECT d.*, d.ClaimNb AS target_claim_count, CAST(d.ClaimNb > 0 AS BIGINT) AS target_has_claim,
       CASE WHEN d.Exposure > 0 THEN d.ClaimNb / d.Exposure ELSE 0e0 END AS target_claim_frequency,
       coalesce(s.total, 0e0) AS target_total_claim_amount, coalesce(s.mean, 0e0) AS target_avg_claim_amount
FROM derived d LEFT JOIN severity s ON d.IDpol = s.IDpol""",
)

PROBABILITY_SQL = (
    "1e0 / (1e0 + exp(-(0.3e0 + CAST(Exposure AS DOUBLE) * 0.9e0 + CAST(VehPower AS DOUBLE) * 0.01e0"
    " + CAST(VehAge AS DOUBLE) * 0.03e0 + CAST(DrivAge AS DOUBLE) * (-0.008e0)"
    " + CAST(BonusMalus AS DOUBLE) * 0.004e0 + Density_log1p * (-0.05e0))))"
)
step("scored", ("modelling",), f"SELECT *, {PROBABILITY_SQL} AS predicted_claim_probability FROM modelling")
step(
    "indexed",
    ("modelling",),
    """SELECT *, row_number() OVER (ORDER BY md5('42:' || IDpol), IDpol) - 1 AS event_index,
       CAST(ntile(20) OVER (ORDER BY md5('42:' || IDpol), IDpol) - 1 AS INTEGER) AS batch_id
FROM modelling""",
)
step(
    "shifted",
    ("indexed",),
    f"""SELECT * REPLACE (CASE WHEN hit THEN Density * 1.35e0 ELSE Density END AS Density,
                  CASE WHEN hit THEN ln(1e0 + Density * 1.35e0) ELSE Density_log1p END AS Density_log1p,
                  CASE WHEN hit THEN {band_sql('(Density * 1.35e0)', *DENSITY)} ELSE Density_band END AS Density_band)
FROM (SELECT *, batch_id >= 12 AND Density_band IN ('1501-5000', '5001+') AS hit FROM indexed)""",
)
step(
    "positive_severity",
    ("shifted",),
    """SELECT row_number() OVER (ORDER BY md5('42:' || IDpol), IDpol) - 1 AS draw, target_avg_claim_amount AS value
FROM shifted WHERE target_avg_claim_amount > 0""",
)
step(
    "drawn",
    ("shifted", "positive_severity"),
    """SELECT s.*, CASE WHEN needs THEN coalesce(v.value, 1000e0) ELSE 0e0 END AS added_severity
FROM (SELECT *, batch_id >= 15 AND BonusMalus >= 100 AS concept_hit,
             batch_id >= 15 AND BonusMalus >= 100 AND target_claim_count < 4 AS needs FROM shifted) s
LEFT JOIN positive_severity v
  ON s.needs AND v.draw = ('0x' || substr(md5('43:' || s.IDpol), 1, 15))::BIGINT % (SELECT count(*) FROM positive_severity)""",
)
step(
    "stream",
    ("drawn",),
    """SELECT IDpol, pool_id, Exposure, VehPower, VehAge, DrivAge, BonusMalus, Density, Density_log1p, VehBrand, VehGas,
       Area, Region, VehAge_band, DrivAge_band, BonusMalus_band, Density_band, batch_id, event_index, hit AS data_drift_injected,
       concept_hit AS concept_drift_injected, added_severity, n AS target_claim_count,
       CASE WHEN concept_hit THEN CAST(n > 0 AS BIGINT) ELSE target_has_claim END AS target_has_claim,
       CASE WHEN NOT concept_hit THEN target_claim_frequency WHEN Exposure > 0 THEN n / Exposure ELSE 0e0 END AS target_claim_frequency,
       total AS target_total_claim_amount,
       CASE WHEN NOT concept_hit THEN target_avg_claim_amount WHEN n > 0 THEN total / n ELSE 0e0 END AS target_avg_claim_amount
FROM (SELECT *, CAST(target_claim_count + CASE WHEN needs THEN 1 ELSE 0 END AS BIGINT) AS n,
             target_total_claim_amount + added_severity AS total FROM drawn)""",
)
step("scored_stream", ("stream",), f"SELECT *, {PROBABILITY_SQL} AS predicted_claim_probability FROM stream")
