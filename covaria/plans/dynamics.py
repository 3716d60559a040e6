"""Queries on state sequences: events of a user in time order, the event's type as state, its value as signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covaria.operators import dynamics
from covaria.plans.common import rounded, table
from covaria.plans.registry import query

STATES = ["click", "error", "purchase", "signup", "view"]
ORDER = ["ts", "event_id"]
SEQUENCE = "SELECT user_id, ts, event_id, event_type, value FROM events"
PAIRS = f"""pairs AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
counted AS (SELECT user_id, a AS from_state, b AS to_state, count(*) AS n FROM pairs WHERE b IS NOT NULL GROUP BY ALL)"""
RUNS = """marked AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS begun FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(begun) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT user_id, run, event_type, count(*) AS length FROM numbered GROUP BY ALL)"""


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.transitions(sequence(spark, sf_dir), "user_id", ORDER, "event_type", F.to_date("ts"))


def _wide_sql() -> str:
    k = range(len(STATES))
    occ = ", ".join(f"count(*) FILTER (WHERE event_type = '{s}') / count(*) AS occ_{i}, coalesce(avg(value * value) FILTER (WHERE event_type = '{s}'), 0) AS energy_{i}" for i, s in enumerate(STATES))
    stay = ", ".join(f"coalesce(avg(length) FILTER (WHERE event_type = '{s}'), 0) AS dwell_{i}" for i, s in enumerate(STATES))
    cell = lambda i, j: f"coalesce(sum(n) FILTER (WHERE from_state = '{STATES[i]}' AND to_state = '{STATES[j]}'), 0)"
    pairs = ", ".join(f"{cell(i, j)}::BIGINT AS tc_{i}_{j}, {cell(i, j)} / greatest(coalesce(sum(n) FILTER (WHERE from_state = '{STATES[i]}'), 0), 1) AS tp_{i}_{j}" for i in k for j in k)
    numbers = [f"occ_{i}" for i in k] + [f"energy_{i}" for i in k] + [f"dwell_{i}" for i in k]
    shares = [f"tp_{i}_{j}" for i in k for j in k]
    picked = ", ".join([f"round({c}, 6) + 0.0 AS {c}" for c in numbers] + [f"coalesce(round({c}, 6), 0) + 0.0 AS {c}" for c in [*shares, "switching_rate", "transition_entropy"]] + [f"coalesce(tc_{i}_{j}, 0) AS tc_{i}_{j}" for i in k for j in k])
    return f"""WITH {PAIRS}, {RUNS},
per AS (SELECT user_id, count(*) AS n, {occ} FROM events GROUP BY user_id), stay AS (SELECT user_id, {stay} FROM runs GROUP BY user_id), tr AS (SELECT user_id, {pairs} FROM counted GROUP BY user_id),
shares AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM counted),
sw AS (SELECT user_id, sum(CASE WHEN from_state <> to_state THEN n ELSE 0 END) / greatest(sum(n), 1) AS switching_rate, -sum(p * ln(p)) AS transition_entropy FROM shares GROUP BY user_id)
SELECT user_id, n, {picked} FROM per JOIN stay USING (user_id) LEFT JOIN tr USING (user_id) LEFT JOIN sw USING (user_id)"""


@query(_wide_sql())
def subject_dynamics_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = sequence(spark, sf_dir).withColumn("energy", F.col("value") * F.col("value"))
    return rounded(dynamics.subject_summary(seq, "user_id", ORDER, "event_type", STATES, "energy", F.to_date("ts")))


@query(f"WITH {RUNS} SELECT user_id, run::BIGINT AS run, event_type, length FROM runs")
def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.runs(sequence(spark, sf_dir), "user_id", ORDER, "event_type", F.to_date("ts"))


@query(f"WITH {RUNS} SELECT user_id, event_type, round(avg(length), 6) + 0.0 AS dwell, count(*) AS visits FROM runs GROUP BY ALL")
def state_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.dwell(sequence(spark, sf_dir), "user_id", ORDER, "event_type", F.to_date("ts")))


@query(f"WITH {PAIRS} SELECT * FROM counted")
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT user_id, from_state, to_state, n, round(n / greatest(sum(n) OVER (PARTITION BY user_id, from_state), 1), 6) + 0.0 AS p FROM counted")
def transition_probs_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.transition_probabilities(counted(spark, sf_dir), "user_id"))


@query(f"""WITH {PAIRS}, s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM counted)
SELECT user_id, round(sum(CASE WHEN from_state <> to_state THEN n ELSE 0 END) / greatest(sum(n), 1), 6) + 0.0 AS switching_rate, round(-sum(p * ln(p)), 6) + 0.0 AS transition_entropy FROM s GROUP BY user_id""")
def switching_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.switching(counted(spark, sf_dir), "user_id"))


@query(f"WITH {PAIRS}, t AS (SELECT from_state, to_state, sum(n)::BIGINT AS n FROM counted GROUP BY ALL) SELECT from_state, to_state, n, round(n / sum(n) OVER (), 6) + 0.0 AS share FROM t")
def cohort_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.cohort_transitions(counted(spark, sf_dir)))


@query("""WITH long AS (SELECT label AS state, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT state, j, avg(v) AS v FROM long GROUP BY ALL)
SELECT s.state::BIGINT AS state, d.j::BIGINT AS j, round(coalesce(m.v, 0), 6) + 0.0 AS v FROM (SELECT unnest(range(11)) AS state) s CROSS JOIN (SELECT unnest(range(64)) AS j) d LEFT JOIN m ON m.state = s.state AND m.j = d.j""")
def state_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(dynamics.centroids(rows, "label", "x", range(11)).withColumn("j", F.col("j").cast("long")))


@query("""WITH long AS (SELECT label AS state, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT state, j, avg(v) AS v FROM long GROUP BY ALL)
SELECT a.state::BIGINT AS state_a, b.state::BIGINT AS state_b, round(sum((a.v - b.v) * (a.v - b.v)), 6) + 0.0 AS distance2 FROM m a JOIN m b ON a.j = b.j AND a.state < b.state GROUP BY ALL""")
def state_pairs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return rounded(dynamics.state_pairs(dynamics.centroids(rows, "label", "x", range(10))))


@query("""SELECT user_id, round(sum(value * value), 6) + 0.0 AS total, round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value * value ELSE 0 END), 6) + 0.0 AS coupled,
round(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN value * value ELSE 0 END) / sum(value * value), 6) + 0.0 AS share FROM events GROUP BY user_id""")
def between_within_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.energy_split(sequence(spark, sf_dir), ["user_id"], "value", F.col("event_type").isin("purchase", "signup")))


@query("""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT DISTINCT event_type FROM events), c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
o AS (SELECT u.user_id, s.event_type, coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY u.user_id) AS p FROM u CROSS JOIN s LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = s.event_type),
l AS (SELECT *, ln((p + 1e-6) / sum(p + 1e-6) OVER (PARTITION BY user_id)) AS ln FROM o)
SELECT user_id, event_type, round(ln - avg(ln) OVER (PARTITION BY user_id), 6) + 0.0 AS clr FROM l""")
def clr_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = sequence(spark, sf_dir)
    per = seq.groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("event_type") == s).alias(s) for s in STATES])
    shares = per.select("user_id", F.explode(F.array(*[F.struct(F.lit(s).alias("event_type"), (F.col(s) / F.col("n")).alias("p")) for s in STATES])).alias("x")).select("user_id", "x.*")
    return rounded(dynamics.clr(shares, ["user_id"], "p").select("user_id", "event_type", "clr"))


@query(f"""WITH {PAIRS}, p AS (SELECT user_id, from_state, to_state, n / sum(n) OVER (PARTITION BY user_id, from_state) AS p FROM counted),
l AS (SELECT *, ln((p + 1e-6) / sum(p + 1e-6) OVER (PARTITION BY user_id, from_state)) AS ln FROM p)
SELECT user_id, from_state, to_state, round(ln - avg(ln) OVER (PARTITION BY user_id, from_state), 6) + 0.0 AS clr FROM l""")
def clr_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = dynamics.transition_probabilities(counted(spark, sf_dir), "user_id")
    return rounded(dynamics.clr(shares, ["user_id", "from_state"], "p").select("user_id", "from_state", "to_state", "clr"))


@query("""SELECT user_id, round(ln(1 + count(*)), 6) + 0.0 AS log_n, round(ln(1 + sum(abs(value))), 6) + 0.0 AS log_abs FROM events GROUP BY user_id""")
def log_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = sequence(spark, sf_dir).groupBy("user_id").agg(F.log(1 + F.count("*")).alias("log_n"), F.log(1 + F.sum(F.abs("value"))).alias("log_abs"))
    return rounded(per)


@query("""WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS state FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, state FROM events JOIN k USING (event_type)""")
def state_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.relabel(sequence(spark, sf_dir).select("event_id", "event_type"), "event_type").select("event_id", F.col("state").cast("long").alias("state"))
