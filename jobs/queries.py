"""The jobs as queries: each runs twice over the whole tables into a new folder, and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boolscope.plans import oracles
from boolscope.sources.files import new_folder
from jobs import dialogue_watch, network_atlas


def job1_network_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three tables of the atlas, told apart by kind."""
    to = new_folder(spark, "network-atlas")
    for _ in range(2):
        network_atlas.run(spark, f"{sf_dir}/lineitem.parquet", to)
    nets, edges, vectors = (network_atlas.table(spark, to, t).withColumn("kind", F.lit(t)) for t in ("networks", "edges", "vectors"))
    out = nets.unionByName(edges, allowMissingColumns=True).unionByName(vectors, allowMissingColumns=True)
    means = ["CycleLenMSQ", "Robustness_std", "Robustness_mean", "mean_robustness_mean", "mean_evolvability", "mean_degree"]
    return out.withColumns({c: F.round(c, 9) for c in means} | {"node": F.col("node").cast("long")})


def job2_dialogue_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and sessions, told apart by kind."""
    to = new_folder(spark, "dialogue-watch")
    for _ in range(2):
        dialogue_watch.run(spark, f"{sf_dir}/conversations.parquet", f"{to}/output", f"{to}/checkpoint")
    hits, sessions = dialogue_watch.result(spark, f"{to}/output")
    return hits.drop("batch").withColumn("kind", F.lit("hit")).unionByName(sessions.drop("bucket").withColumn("kind", F.lit("session")), allowMissingColumns=True)


def _atlas_oracle() -> str:
    """Networks by their definition: weights state by state, mutants by comparing columns, walks, faces by recursion."""
    bits_ = lambda f: f"list_aggregate([CAST(({f} >> CAST(s AS INT)) & 1 AS VARCHAR) FOR s IN range(8)], 'string_agg', '')"
    ids = "f_1 * 65536 + f_2 * 256 + f_3"
    edge = lambda k: f"SELECT x.f_1 * 65536 + x.f_2 * 256 + x.f_3 AS a, {' + '.join(('n.dst' if j == k else f'x.f_{j}') + f' * {256 ** (3 - j)}' for j in (1, 2, 3))} AS b, {k} AS node FROM networks AS x JOIN neighbours AS n ON x.f_{k} = n.src"
    edges = " UNION ALL ".join(map(edge, (1, 2, 3)))
    weights = ", ".join(f'CAST(c{j}.w_{i} AS BIGINT) AS "w_{i},{j}"' for i in (1, 2, 3) for j in (1, 2, 3))
    table = " ".join(f"JOIN table_ AS t{j} ON t{j}.tt = n.f_{j} JOIN columns_ AS c{j} ON c{j}.id = t{j}.rep" for j in (1, 2, 3))
    total = lambda c: " + ".join(f"t{j}.{c}" for j in (1, 2, 3))
    every = ["v_3", "v_2", "v_1", "v_0", "f_1", "f_2", "f_3", *(f'"w_{i},{j}"' for i in (1, 2, 3) for j in (1, 2, 3)), "CycleLenMSQ", "NumAttractors", "GenotypeCount", "Robustness_std", "Robustness_mean", "Evolvability", "draws", "degree", "leaves"]
    extra = ["a", "b", "node", "vector", "networks", "mean_robustness_mean", "mean_evolvability", "mean_degree"]
    row = lambda kind, given: f"SELECT '{kind}' AS kind, " + ", ".join(f"{given.get(c, 'NULL')} AS {c}" for c in every + extra)
    own = {c: c for c in every}
    return f"""{oracles._finest(oracles._DRAWS)}, {oracles._neutral(3)}, {oracles._walks(3)},
    cycles AS (SELECT f_1, f_2, f_3, length, count(*) // any_value(length) AS n FROM cyclic GROUP BY ALL),
    attractors AS (SELECT f_1, f_2, f_3, CAST(sum(n) AS BIGINT) AS NumAttractors, round(sum(n * length * length) / sum(n), 9) AS CycleLenMSQ FROM cycles GROUP BY ALL),
    both_ways AS ({edges}), ids AS (SELECT {ids} AS id FROM networks),
    pairs AS (SELECT e.a, e.b, e.node FROM both_ways AS e JOIN ids ON ids.id = e.b),
    degrees AS (SELECT a, count(*) AS degree FROM pairs GROUP BY a),
    often AS (SELECT f_1, f_2, f_3, count(*) AS draws FROM draws GROUP BY ALL),
    made AS (SELECT CAST(v[4] AS BIGINT) AS v_3, CAST(v[3] AS BIGINT) AS v_2, CAST(v[2] AS BIGINT) AS v_1, CAST(v[1] AS BIGINT) AS v_0, {", ".join(f"{bits_(f'n.f_{i}')} AS f_{i}" for i in (1, 2, 3))}, {weights}, CycleLenMSQ, NumAttractors,
      t1.n_cols * t2.n_cols * t3.n_cols AS GenotypeCount, round(sqrt({total("neutral_var")}) / 36, 9) AS Robustness_std, round(({total("neutral_mean")}) / 36, 9) AS Robustness_mean, {total("evolvability")} AS Evolvability,
      draws, coalesce(degree, 0) AS degree, CAST(list_sum(v) AS BIGINT) AS leaves, vector, ({total("neutral_mean")}) / 36 AS exact
      FROM finest AS n JOIN often USING (f_1, f_2, f_3) JOIN attractors USING (f_1, f_2, f_3) {table} LEFT JOIN degrees AS g ON g.a = n.f_1 * 65536 + n.f_2 * 256 + n.f_3)
    {row("networks", own)} FROM made UNION ALL {row("edges", {"a": "a", "b": "b", "node": "node"})} FROM pairs WHERE a < b
    UNION ALL {row("vectors", {"leaves": "leaves", "vector": "vector", "networks": "count(*)", "draws": "CAST(sum(draws) AS BIGINT)", "mean_robustness_mean": "round(avg(exact), 9)", "mean_evolvability": "round(avg(Evolvability), 9)", "mean_degree": "round(avg(degree), 9)"})} FROM made GROUP BY leaves, vector"""


def _watch_oracle() -> str:
    width, settings = dialogue_watch.DEFAULTS["width"], dialogue_watch.DEFAULTS
    hits, sums = [], []
    for s in settings["searches"]:
        role = f"role = '{s['role']}'" if s["role"] else "TRUE"
        hits.append(
            f"SELECT conv_id, turn, role, '{s['name']}' AS search, len(regexp_extract_all(t, '(?i){s['pattern']}')) AS places, t, greatest(length(regexp_extract(t, '(?is)^(.*?)(?:{s['pattern']})', 1)) - {width // 3}, 0) AS start FROM squeezed WHERE {role} AND regexp_matches(t, '(?i){s['pattern']}')"
        )
        sums.append(f"CAST(coalesce((SELECT sum(places) FROM hits AS h WHERE h.conv_id IS NOT DISTINCT FROM c.conv_id AND search = '{s['name']}'), 0) AS BIGINT) AS {s['name']}_places")
    roles = ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS {r}_turns" for r in settings["roles"])
    columns = ["turns", "characters", "first_turn", "last_turn", *(f"{r}_turns" for r in settings["roles"]), *(f"{s['name']}_places" for s in settings["searches"])]
    return f"""WITH squeezed AS (SELECT conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM conversations),
    hits AS ({" UNION ALL ".join(hits)}),
    c AS (SELECT conv_id, count(*) AS turns, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters, min(turn) AS first_turn, max(turn) AS last_turn, {roles} FROM conversations GROUP BY conv_id),
    s AS (SELECT *, {", ".join(sums)} FROM c)
    SELECT 'hit' AS kind, conv_id, turn, role, search, CAST(places AS BIGINT) AS places, CASE WHEN start > 0 THEN '...' ELSE '' END || substring(t, start + 1, {width}) || CASE WHEN length(t) > start + {width} THEN '...' ELSE '' END AS extract, {", ".join(f"NULL AS {c}" for c in columns)} FROM hits
    UNION ALL SELECT 'session', conv_id, NULL, NULL, NULL, NULL, NULL, {", ".join(columns)} FROM s"""


QUERIES = {"job1_network_atlas": job1_network_atlas, "job2_dialogue_watch": job2_dialogue_watch}
ORACLES = {"job1_network_atlas": _atlas_oracle(), "job2_dialogue_watch": _watch_oracle()}
