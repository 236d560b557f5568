"""Queries over dialogues, file names and trees as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import trees
from ..functions.dialect import Dialect
from ..operators import decomposition as dec
from ..sources import files, scans
from .networks import drawn_once
from .registry import paired, rows, run_sql, sql

PATTERN = "(?i)(the|de) [a-z]*ti"


def turns(q: Dialect) -> str:
    """Turns by a user or an assistant with text, blocks in tags taken out."""
    clean = "regexp_replace(text, '<[^>]*>', ' ')" if q.name == "spark" else "regexp_replace(text, '<[^>]*>', ' ', 'g')"
    return f"(SELECT conv_id, turn, role, {clean} AS text FROM {q.table('conversations')} WHERE role IN ('user', 'assistant') AND text IS NOT NULL AND length(text) > 0)"


def solver_oracle() -> str:
    """The networks themselves, from weights state by state."""
    tt = "list_sum([CASE WHEN {0} * (s & 1) + {1} * (s >> 1) > 0 THEN CAST(1 AS BIGINT) << s ELSE 0 END FOR s IN [0, 1, 2, 3]])"
    w = "(SELECT CAST(a.x AS INT) AS p, CAST(b.x AS INT) AS q, row_number() OVER (ORDER BY a.x, b.x) - 1 AS id FROM range(-1, 2) AS a(x), range(-1, 2) AS b(x))"
    columns = f"CAST({tt.format('a.p', 'a.q')} AS BIGINT) AS f_1, CAST({tt.format('b.p', 'b.q')} AS BIGINT) AS f_2, a.p AS w_1_1, a.q AS w_1_2, b.p AS w_2_1, b.q AS w_2_2"
    return f"SELECT {columns} FROM orders JOIN {w} AS a ON a.id = o_orderkey % 9 JOIN {w} AS b ON b.id = o_custkey % 9"


@sql
def dialogue_turns(q):
    return f"SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS characters FROM {turns(q)} AS t GROUP BY role"


@sql
def dialogue_matches(q):
    return f"SELECT conv_id, turn, role FROM {turns(q)} AS t WHERE {q.matches('text', PATTERN)} AND role = 'user'"


@sql
def dialogue_session_matches(q):
    """Matches in the sessions whose number begins with 1."""
    kind = "STRING" if q.name == "spark" else "VARCHAR"
    return f"SELECT conv_id, turn, role FROM {turns(q)} AS t WHERE {q.matches('text', PATTERN)} AND CAST(conv_id AS {kind}) LIKE '1%'"


@sql
def dialogue_matches_in_context(q):
    """Turns at most one away from a match, with whether they match themselves."""
    hit = f"(SELECT conv_id, turn, role, CASE WHEN {q.matches('text', PATTERN)} THEN 1 ELSE 0 END AS hit FROM {turns(q)} AS t)"
    near = f"(SELECT *, max(hit) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM {hit} AS h)"
    return f"SELECT conv_id, turn, role, CAST(hit AS BIGINT) AS hit FROM {near} AS n WHERE near = 1"


@sql
def dialogue_snippets(q):
    """30 characters around the first match of a plain word."""
    at = q.find("lower(text)", "'the '")
    return f"SELECT conv_id, turn, CASE WHEN first_at > 11 THEN '...' ELSE '' END || substring(text, CAST(greatest(first_at - 10, 1) AS INT), 30) AS snippet FROM (SELECT *, {at} AS first_at FROM {turns(q)} AS t) AS f WHERE first_at > 0"


@sql
def file_name_metadata(q):
    """Nodes and vector from both spellings of result files' names."""
    names = ["3d_<0,2,0,0>_SBN.csv", "3d__0_2_0_0__SBN.csv", "4d_MCSBN_variety.csv.gz", "notes.txt"]
    rows_ = ", ".join(f"('{n}')" for n in names)
    d = q.extract("name", "^([0-9]+)d_", 1)
    v = q.extract("name", "^[0-9]+d_[<_]([0-9]+([,_][0-9]+)+)[>_]", 1)
    return f"SELECT name, {d} AS nodes, replace({v}, '_', ',') AS vector FROM (SELECT * FROM (VALUES {rows_}) AS n(name)) AS n"


@sql
def timing_medians(q):
    return f"SELECT o_orderpriority, {q.median('o_totalprice')} AS middle, count(*) AS runs FROM {q.table('orders')} GROUP BY o_orderpriority"


@rows
def parsed_trees(spark, sf_dir):
    """Leaves, depth and whether each depth has one label, of the trees that drawn networks admit."""
    found = run_sql(spark, lambda q: f"SELECT tree, count(*) AS networks FROM {dec.decomposed(drawn_once(q), 3)} AS t GROUP BY tree", sf_dir)
    return trees.shapes(found)


@paired(solver_oracle())
def solver_answers(spark, sf_dir):
    """Networks of 2 nodes with their weights read back from solver answers; half of the answers renumber the nodes."""
    nets = run_sql(spark, lambda q: f"SELECT o.o_orderkey AS id, a.tt AS f_1, b.tt AS f_2, a.w_1 AS w_1_1, a.w_2 AS w_1_2, b.w_1 AS w_2_1, b.w_2 AS w_2_2 FROM {q.table('orders')} AS o JOIN {scans.weights(q, 2)} AS a ON a.id = o.o_orderkey % 9 JOIN {scans.weights(q, 2)} AS b ON b.id = o.o_custkey % 9", sf_dir)
    turned = F.col("id") % 2 == 1
    atoms = [F.when(F.col(f"f_{i}").bitwiseAND(1 << s) != 0, F.lit(f"transition_function_bit({i},{s})")) for i in (1, 2) for s in range(4)]
    sigma = F.when(turned, "sigma(1,2) sigma(2,1)").otherwise("sigma(1,1) sigma(2,2)")
    old = lambda n: F.when(turned, 3 - n).otherwise(n)
    given = [F.concat(F.lit("w("), old(i), F.lit(","), old(j), F.lit(")="), F.col(f"w_{i}_{j}")) for i in (1, 2) for j in (1, 2)]
    text = nets.select(F.concat_ws("\n", F.concat(F.lit("Answer: "), "id"), F.concat_ws(" ", *atoms, sigma), F.lit(""), F.concat_ws(" ", *given)).alias("value"))
    return files.answers(text, 2)
