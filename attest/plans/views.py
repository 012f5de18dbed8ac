"""Evidence-shaped views over the star-schema tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARMS = [(0, "short", 3.0), (1, "long", 6.0), (2, "resonant", 8.0), (3, "minimal", 0.25)]
STRATA = [("slow", 0.0833, 0.1667), ("normal", 0.1667, None)]
ALPHA = 0.05
FS = 4.0

# view -> (base table, projection both engines accept)
PROJECTIONS: dict[str, tuple[str, list[str]]] = {
    "v_ledger": ("lineitem", [
        "concat('part/', l_partkey % 50) AS url",
        "(l_orderkey % 5000) * 100 AS start_b",
        "(l_orderkey % 5000) * 100 + CAST(l_quantity AS BIGINT) * 20 - 1 AS end_b",
        "l_shipdate AS first_read_at",
        "concat('EXP-', l_suppkey % 7) AS first_read_by",
        "l_orderkey AS order_no", "l_linenumber AS line_no"]),
    "v_wanted": ("orders", [
        "o_orderkey AS req_id",
        "concat('part/', o_custkey % 60) AS url",
        "(o_orderkey % 5000) * 100 + 37 AS start_b",
        "(o_orderkey % 5000) * 100 + 137 + (o_custkey % 400) AS end_b",
        "o_orderdate AS moment",
        "concat('EXP-', o_custkey % 7) AS exp_id"]),
    "v_windows": ("orders", [
        "o_orderkey AS window_id", "o_custkey % 40 AS record", "o_orderkey % 10 AS segment",
        "CAST((o_custkey * 37 + o_orderkey * 11) % 400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS freq_hz"]),
    "v_samples": ("events", [
        "user_id AS record", "event_id", "ts", "value AS x", "event_type AS channel"]),
    "v_docs": ("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
}

_ADJ = ("CASE WHEN ({w} * 31 + n * 17) % 100 < {t} "
        "THEN CAST(1 + {w} % 10 AS DOUBLE) / CAST(200 AS DOUBLE) "
        "ELSE CAST(11 + {w} % 189 AS DOUBLE) / CAST(200 AS DOUBLE) END")
_TEST_COLUMNS = [
    "window_id", "record", "segment", "freq_hz", "arm",
    "1 + (window_id + n) % 12 AS fwd_lag",
]


def _tests(kind: str, shift: int, threshold: str) -> list[str]:
    shifted = f"(window_id + {shift})"
    return [*_TEST_COLUMNS, f"'{kind}' AS kind", _ADJ.format(w=shifted, t=threshold) + " AS fwd_adj_p",
            _ADJ.format(w=f"(window_id + {shift + 3})", t="20 + n") + " AS rev_adj_p"]


REAL = _tests("real", 0, "70 + n * 5")
MISMATCHED = _tests("mismatched", 7, "4 + n")
CONTROL_KINDS = {"positive": "90 + n", "null": "5", "long_lag": "60 + n * 10"}
CONTROLS = {kind: ["c_custkey AS window_id", "CAST(NULL AS BIGINT) AS record", "CAST(NULL AS BIGINT) AS segment",
                   "CAST(NULL AS DOUBLE) AS freq_hz", "arm", "1 + (c_custkey + n) % 12 AS fwd_lag",
                   f"'{kind}' AS kind", _ADJ.format(w="c_custkey", t=t) + " AS fwd_adj_p",
                   _ADJ.format(w="(c_custkey + 3)", t="20 + n") + " AS rev_adj_p"]
            for kind, t in CONTROL_KINDS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = PROJECTIONS[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_ledger").withColumn(
        "sha256", F.sha2(F.concat("url", F.lit("#"), "start_b", F.lit("-"), "end_b"), 256))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_wanted")


def with_arms(df: DataFrame, arms: list[tuple] = ARMS) -> DataFrame:
    """Every row under every arm: the arms are literals, so no join is needed."""
    literals = [F.struct(F.lit(n).alias("n"), F.lit(a).alias("arm"), F.lit(m).alias("max_lag_s")) for n, a, m in arms]
    return df.select("*", F.inline(F.array(*literals)))


def real_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_arms(view(spark, sf_dir, "v_windows")).selectExpr(*REAL)


def mismatched_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_arms(view(spark, sf_dir, "v_windows")).selectExpr(*MISMATCHED)


def control_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = with_arms(table(spark, sf_dir, "customer").select("c_custkey"))
    out = None
    for columns in CONTROLS.values():
        part = base.selectExpr(*columns)
        out = part if out is None else out.unionByName(part)
    return out


def study_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (real_tests(spark, sf_dir).unionByName(mismatched_tests(spark, sf_dir))
            .unionByName(control_tests(spark, sf_dir)))


def _projection_sql(name: str) -> str:
    base, columns = PROJECTIONS[name]
    extra = ", sha256(concat(url, '#', start_b, '-', end_b)) AS sha256" if name == "v_ledger" else ""
    inner = f"SELECT {', '.join(columns)} FROM {base}"
    return f"SELECT *{extra} FROM ({inner}) q" if extra else inner


_ARMS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{a}', CAST({m} AS DOUBLE))" for n, a, m in ARMS) \
    + ") AS a(n, arm, max_lag_s)"
_STRATUM_SQL = ("CASE WHEN freq_hz >= CAST(0.0833 AS DOUBLE) AND freq_hz < CAST(0.1667 AS DOUBLE) THEN 'slow' "
                "WHEN freq_hz >= CAST(0.1667 AS DOUBLE) THEN 'normal' END")


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    **{name: ([], _projection_sql(name)) for name in PROJECTIONS},
    "v_arms": ([], _ARMS_SQL),
    "v_real": (["v_windows", "v_arms"], f"SELECT {', '.join(REAL)} FROM v_windows CROSS JOIN v_arms"),
    "v_mismatched": (["v_windows", "v_arms"], f"SELECT {', '.join(MISMATCHED)} FROM v_windows CROSS JOIN v_arms"),
    "v_controls": (["v_arms"], _union([f"SELECT {', '.join(c)} FROM customer CROSS JOIN v_arms"
                                       for c in CONTROLS.values()])),
    "v_tests": (["v_real", "v_mismatched", "v_controls"],
                "SELECT * FROM v_real UNION ALL BY NAME SELECT * FROM v_mismatched "
                "UNION ALL BY NAME SELECT * FROM v_controls"),
    "v_strat": (["v_tests"], f"SELECT *, {_STRATUM_SQL} AS stratum, fwd_adj_p <= CAST(0.05 AS DOUBLE) AS hit FROM v_tests"),
    "v_pairs": ([], "SELECT a.vec_id AS window_id, a.label AS segment, a.embedding AS source, b.embedding AS target "
                    "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
}


def sql(views: str, body: str) -> str:
    """``body`` behind the named views (and what they need) as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for other in SQL_VIEWS[name][0]:
            need(other)
        order.append(name)

    for name in views.split():
        need(name)
    heads = [f"{name} AS ({SQL_VIEWS[name][1]})" for name in order]
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + body[15:]
    if body.lower().startswith("with "):
        return "WITH " + ",\n".join(heads) + ",\n" + body[5:]
    return "WITH " + ",\n".join(heads) + "\n" + body


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("window_id"), F.col("label").alias("segment"), F.col("embedding").alias("source"))
    b = e.select((F.col("vec_id") - 1).alias("window_id"), F.col("embedding").alias("target"))
    return a.join(b, "window_id")
