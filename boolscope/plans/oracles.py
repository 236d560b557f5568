"""SQL for the oracle that doesn't share the queries' text: networks by their definition, and published counts.

Truth tables come from weights state by state, statistics from matrices of weights and their mutants, attractors from
walks, vectors from faces of the state cube by recursion over their dimensions.
"""

from __future__ import annotations


def _columns(d: int, bound: int) -> str:
    """CTE columns: (id, w_1 .. w_d, tt) of a size, in order of weights."""
    names = [f"w_{i}" for i in range(1, d + 1)]
    froms = ", ".join(f"range({-bound}, {bound + 1}) AS r_{i}(w_{i})" for i in range(1, d + 1))
    total = " + ".join(f"w_{i} * ((s >> {i - 1}) & 1)" for i in range(1, d + 1))
    return f"""listed AS (SELECT row_number() OVER (ORDER BY {", ".join(names)}) - 1 AS id, {", ".join(names)} FROM {froms}),
    columns_ AS (SELECT id, {", ".join(names)}, CAST(sum(CASE WHEN {total} > 0 THEN 1 << CAST(s AS INT) ELSE 0 END) AS BIGINT) AS tt FROM listed, range({1 << d}) AS states(s) GROUP BY ALL)"""


def _neutral(d: int) -> str:
    """CTEs neighbours (src, dst) and table_: pairs of columns that differ in one weight are found by comparing all."""
    differ = " + ".join(f"CAST(a.w_{i} <> b.w_{i} AS INT)" for i in range(1, d + 1))
    return f"""mutants AS (SELECT a.id, a.tt, b.tt AS to_tt FROM columns_ AS a JOIN columns_ AS b ON {differ} = 1),
    neighbours AS (SELECT DISTINCT tt AS src, to_tt AS dst FROM mutants WHERE tt <> to_tt),
    neutral AS (SELECT id, tt, count(*) FILTER (WHERE tt = to_tt) AS n FROM mutants GROUP BY id, tt),
    table_ AS (SELECT tt, count(*) AS n_cols, min(id) AS rep, avg(n) AS neutral_mean, var_pop(n) AS neutral_var, (SELECT count(*) FROM neighbours WHERE src = neutral.tt) AS evolvability FROM neutral GROUP BY tt)"""


_DRAWS = """numbered AS (SELECT tt, row_number() OVER (ORDER BY tt) - 1 AS idx FROM (SELECT DISTINCT tt FROM columns_)),
    draws AS (SELECT l_orderkey, l_linenumber, a.tt AS f_1, b.tt AS f_2, c.tt AS f_3 FROM lineitem
      JOIN numbered AS a ON a.idx = l_orderkey % 32 JOIN numbered AS b ON b.idx = l_partkey % 32 JOIN numbered AS c ON c.idx = l_suppkey % 32),
    networks AS (SELECT DISTINCT f_1, f_2, f_3 FROM draws)"""
_ALL = """tables_ AS (SELECT DISTINCT tt FROM columns_),
    networks AS (SELECT a.tt AS f_1, b.tt AS f_2, c.tt AS f_3 FROM tables_ AS a, tables_ AS b, tables_ AS c)"""


def _walks(d: int) -> str:
    """CTEs steps (f, s, t) and cyclic (f, s, length): a state is on a cycle if a walk of 2^d steps or less comes back."""
    f, n = ", ".join(f"f_{i}" for i in range(1, d + 1)), 1 << d
    to = " + ".join(f"((f_{i} >> CAST(s AS INT)) & 1) * {1 << (i - 1)}" for i in range(1, d + 1))
    same = " AND ".join(f"w.f_{i} = x.f_{i}" for i in range(1, d + 1))
    return f"""steps AS (SELECT {f}, s, {to} AS t FROM networks, range({n}) AS states(s)),
    walks AS (SELECT {f}, s, t, 1 AS k FROM steps UNION ALL SELECT {", ".join("w." + x for x in f.split(", "))}, w.s, x.t, w.k + 1 FROM walks AS w JOIN steps AS x ON {same} AND w.t = x.s WHERE w.k < {n}),
    cyclic AS (SELECT {f}, s, min(k) AS length FROM walks WHERE t = s GROUP BY ALL)"""


_VECTORS = """states AS (SELECT CAST(s AS INT) AS s FROM range(8) AS r(s)),
    faces AS (SELECT CAST(a.x AS INT) AS fixed, CAST(b.x AS INT) AS held, 3 - bit_count(CAST(a.x AS INT)) AS dim FROM range(8) AS a(x), range(8) AS b(x) WHERE b.x & a.x = b.x),
    nodes AS (SELECT CAST(i AS INT) AS i FROM range(3) AS r(i)),
    controls AS (SELECT f_1, f_2, f_3, fixed, held, i FROM networks, faces, nodes, states
      WHERE s & fixed = held AND (fixed >> i) & 1 = 0 GROUP BY ALL
      HAVING bool_and(((CASE i WHEN 0 THEN f_1 WHEN 1 THEN f_2 ELSE f_3 END >> s) & 1) = ((s >> i) & 1))),
    best_0 AS (SELECT f_1, f_2, f_3, fixed, held, [1, 0, 0, 0] AS v FROM networks, faces WHERE dim = 0)"""


def _level(k: int) -> str:
    """CTE best_k: the finest vector of each face of k dimensions, [points, edges, squares, cube]: of most leaves."""
    leaf = "[" + ", ".join("1" if j == k else "0" for j in range(4)) + "]"
    both = "[" + ", ".join(f"a.v[{j}] + b.v[{j}]" for j in range(1, 5)) + "]"
    return f"""tried_{k} AS (SELECT f_1, f_2, f_3, fixed, held, {leaf} AS v FROM networks, faces WHERE dim = {k}
      UNION ALL SELECT c.f_1, c.f_2, c.f_3, c.fixed, c.held, {both} FROM controls AS c
      JOIN best_{k - 1} AS a ON a.f_1 = c.f_1 AND a.f_2 = c.f_2 AND a.f_3 = c.f_3 AND a.fixed = c.fixed | (1 << c.i) AND a.held = c.held
      JOIN best_{k - 1} AS b ON b.f_1 = c.f_1 AND b.f_2 = c.f_2 AND b.f_3 = c.f_3 AND b.fixed = c.fixed | (1 << c.i) AND b.held = c.held | (1 << c.i)
      WHERE bit_count(c.fixed) = {3 - k}),
    best_{k} AS (SELECT f_1, f_2, f_3, fixed, held, arg_max(v, list_prepend(list_sum(v), v)) AS v FROM tried_{k} GROUP BY ALL)"""


def _finest(networks: str) -> str:
    parts = ",\n    ".join([_columns(3, 2), networks, _VECTORS, *(_level(k) for k in (1, 2, 3))])
    return f"WITH RECURSIVE {parts},\n    finest AS (SELECT f_1, f_2, f_3, v, '<' || v[4] || ',' || v[3] || ',' || v[2] || ',' || v[1] || '>' AS vector FROM best_3)"


_GENOTYPES_2 = f"""{_columns(2, 1)},
    genotypes AS (SELECT a.tt AS f_1, b.tt AS f_2, a.w_1 AS p, a.w_2 AS q, b.w_1 AS r, b.w_2 AS t FROM columns_ AS a, columns_ AS b),
    changed AS (SELECT x.f_1, x.f_2, x.p, x.q, x.r, x.t, y.f_1 AS g_1, y.f_2 AS g_2 FROM genotypes AS x JOIN genotypes AS y
      ON CAST(x.p <> y.p AS INT) + CAST(x.q <> y.q AS INT) + CAST(x.r <> y.r AS INT) + CAST(x.t <> y.t AS INT) = 1),
    networks AS (SELECT DISTINCT f_1, f_2 FROM genotypes)"""


def _close(most: int) -> str:
    """SQL that counts pairs of draws by the distance of their attractors: cycles by walks, a matrix of the distances of all
    cycles, and profiles met state by state while the sum stays small."""
    turned = "list_min([list_sum([bit_count(xor(x.seq[(i + r) % len(x.seq) + 1], CASE WHEN i < len(y.seq) THEN y.seq[i + 1] ELSE 0 END)) FOR i IN range(len(x.seq))]) FOR r IN range(len(x.seq))])"
    steps = ["at_0 AS (SELECT u.p AS u, u.c AS uc, v.p AS v, v.c AS vc, u.n * v.n AS pairs, d.d AS dda FROM numbered_profiles AS u JOIN matrix AS d ON d.a = u.c[1] JOIN numbered_profiles AS v ON v.c[1] = d.b AND u.p < v.p)"]
    steps += [f"at_{s} AS (SELECT u, uc, v, vc, pairs, dda + d.d AS dda FROM at_{s - 1} JOIN matrix AS d ON d.a = uc[{s + 1}] AND d.b = vc[{s + 1}] AND dda + d.d <= {most})" for s in range(1, 8)]
    return f"""WITH RECURSIVE {_columns(3, 2)}, {_DRAWS}, {_walks(3)},
    ends AS (SELECT f_1, f_2, f_3, s, t AS c FROM walks WHERE k = 8),
    least AS (SELECT f_1, f_2, f_3, s AS c, min(t) AS m FROM walks GROUP BY ALL),
    seqs AS (SELECT w.f_1, w.f_2, w.f_3, w.s AS m, list_prepend(any_value(w.s), coalesce(list(w.t ORDER BY w.k) FILTER (WHERE w.k < c.length), [])) AS seq FROM walks AS w JOIN cyclic AS c USING (f_1, f_2, f_3, s) GROUP BY w.f_1, w.f_2, w.f_3, w.s),
    dictionary AS (SELECT seq, row_number() OVER (ORDER BY seq) AS id FROM (SELECT DISTINCT seq FROM seqs)),
    each AS (SELECT f_1, f_2, f_3, list(d.id ORDER BY e.s) AS c FROM ends AS e JOIN least AS l USING (f_1, f_2, f_3, c) JOIN seqs AS q USING (f_1, f_2, f_3, m) JOIN dictionary AS d USING (seq) GROUP BY ALL),
    numbered_profiles AS (SELECT c, count(*) AS n, row_number() OVER (ORDER BY c) AS p FROM each GROUP BY c),
    halves AS (SELECT x.id AS a, y.id AS b, {turned} AS d FROM dictionary AS x, dictionary AS y WHERE len(x.seq) >= len(y.seq)),
    matrix AS (SELECT a, b, min(d) AS d FROM (SELECT a, b, d FROM halves UNION ALL SELECT b, a, d FROM halves) GROUP BY a, b HAVING min(d) <= {most}),
    {", ".join(steps)}
    SELECT CAST(dda AS BIGINT) AS dda, CAST(sum(pairs) AS BIGINT) AS pairs FROM (SELECT dda, pairs FROM at_7 UNION ALL SELECT 0, n * (n - 1) // 2 FROM numbered_profiles) GROUP BY dda"""


CLOSE_ATTRACTORS = _close(2)


def _counts(name: str, values: list[int], first: int) -> str:
    rows = ", ".join(f"({d}, {n})" for d, n in enumerate(values, first))
    return f"SELECT CAST(d AS BIGINT) AS d, CAST(n AS BIGINT) AS {name} FROM (VALUES {rows}) AS published(d, n)"


ORACLES = {
    "function_table_d3": f"WITH {_columns(3, 2)}, {_neutral(3)} SELECT tt, n_cols, rep, round(neutral_mean, 9) AS neutral_mean, round(neutral_var, 9) AS neutral_var, evolvability, row_number() OVER (ORDER BY tt) - 1 AS idx FROM table_",
    "function_table_d4": f"WITH {_columns(4, 3)}, {_neutral(4)} SELECT tt, n_cols, rep, round(neutral_mean, 9) AS neutral_mean, round(neutral_var, 9) AS neutral_var, evolvability FROM table_",
    "function_neighbours_d3": f"WITH {_columns(3, 2)}, {_neutral(3)} SELECT src, dst FROM neighbours",
    "neighbour_degrees_d4": f"WITH {_columns(4, 3)}, {_neutral(4)} SELECT src, count(*) AS degree FROM neighbours GROUP BY src",
    "all_networks_d2": f"""WITH RECURSIVE {_GENOTYPES_2}, {_walks(2)},
    kept AS (SELECT f_1, f_2, p, q, r, t, count(*) FILTER (WHERE f_1 = g_1 AND f_2 = g_2) / count(*) AS share FROM changed GROUP BY f_1, f_2, p, q, r, t),
    robust AS (SELECT f_1, f_2, count(*) AS genotype_count, avg(share) AS robustness_mean, stddev_pop(share) AS robustness_std FROM kept GROUP BY ALL),
    evolved AS (SELECT f_1, f_2, count(DISTINCT (g_1, g_2)) AS evolvability FROM changed WHERE (f_1, f_2) <> (g_1, g_2) GROUP BY ALL),
    cycles AS (SELECT f_1, f_2, length, count(*) // any_value(length) AS n FROM cyclic GROUP BY ALL)
    SELECT f_1, f_2, list_aggregate([CAST((f_1 >> CAST(s AS INT)) & 1 AS VARCHAR) FOR s IN range(4)], 'string_agg', '') AS bits_1, genotype_count, round(robustness_mean, 9) AS robustness_mean, round(robustness_std, 9) AS robustness_std, evolvability,
      CAST(num_attractors AS BIGINT) AS num_attractors, round(cycle_len_msq, 9) AS cycle_len_msq
    FROM robust JOIN evolved USING (f_1, f_2) JOIN (SELECT f_1, f_2, sum(n) AS num_attractors, sum(n * length * length) / sum(n) AS cycle_len_msq FROM cycles GROUP BY ALL) USING (f_1, f_2)""",
    "mutation_edges_d2": f"WITH {_GENOTYPES_2} SELECT DISTINCT f_1 * 16 + f_2 AS a, g_1 * 16 + g_2 AS b FROM changed WHERE f_1 * 16 + f_2 < g_1 * 16 + g_2",
    "mutation_edge_count_d3": f"WITH {_columns(3, 2)}, {_neutral(3)} SELECT 3 * 32 * 32 * count(*) // 2 AS edges FROM neighbours",
    "draw_attractors": f"""WITH RECURSIVE {_columns(3, 2)}, {_DRAWS}, {_walks(3)}, cycles AS (SELECT f_1, f_2, f_3, length, count(*) // any_value(length) AS n FROM cyclic GROUP BY ALL)
    SELECT f_1, f_2, f_3, CAST(sum(n) AS BIGINT) AS num_attractors, round(sum(n * length * length) / sum(n), 9) AS cycle_len_msq FROM cycles GROUP BY ALL""",
    "attractor_histogram_d3": f"""WITH RECURSIVE {_columns(3, 2)}, {_ALL}, {_walks(3)}, cycles AS (SELECT f_1, f_2, f_3, length, count(*) // any_value(length) AS n FROM cyclic GROUP BY ALL),
    each AS (SELECT f_1, f_2, f_3, CAST(sum(n) AS BIGINT) AS num_attractors, round(sum(n * length * length) / sum(n), 9) AS cycle_len_msq FROM cycles GROUP BY ALL)
    SELECT num_attractors, cycle_len_msq, count(*) AS networks FROM each GROUP BY ALL""",
    "basin_sizes": f"""WITH RECURSIVE {_GENOTYPES_2}, {_walks(2)},
    ends AS (SELECT w.f_1, w.f_2, w.s, min(w.t) AS attractor FROM walks AS w JOIN cyclic AS c ON w.f_1 = c.f_1 AND w.f_2 = c.f_2 AND w.t = c.s GROUP BY ALL)
    SELECT f_1, f_2, attractor, count(*) AS basin FROM ends GROUP BY ALL""",
    "draw_successors": f"WITH RECURSIVE {_columns(3, 2)}, {_DRAWS}, {_walks(3)} SELECT f_1, f_2, f_3, s, t FROM steps",
    "draw_decomposition_census": f"{_finest(_DRAWS)} SELECT vector, count(DISTINCT (f_1, f_2, f_3)) AS networks, count(*) AS draws FROM draws JOIN finest USING (f_1, f_2, f_3) GROUP BY vector",
    "draws_of_a_vector": f"{_finest(_DRAWS)} SELECT f_1, f_2, f_3 FROM finest WHERE v = [0, 0, 2, 0]",
    "top_decomposed_draws": f"{_finest(_DRAWS)} SELECT f_1, f_2, f_3, CAST(list_sum(v) AS BIGINT) AS leaves FROM finest ORDER BY leaves DESC, f_1, f_2, f_3 LIMIT 20",
    "spearman_of_statistics_d3": f"""WITH {_columns(3, 2)}, {_neutral(3)},
    all_ AS (SELECT a.n_cols * b.n_cols * c.n_cols AS g, round((a.neutral_mean + b.neutral_mean + c.neutral_mean) / 36, 9) AS r, a.evolvability + b.evolvability + c.evolvability AS e FROM table_ AS a, table_ AS b, table_ AS c),
    places AS (SELECT *, row_number() OVER (ORDER BY g) AS pg, row_number() OVER (ORDER BY r) AS pr, row_number() OVER (ORDER BY e) AS pe FROM all_),
    means AS (SELECT avg(pg) OVER (PARTITION BY g) AS a, avg(pr) OVER (PARTITION BY r) AS b, avg(pe) OVER (PARTITION BY e) AS c FROM places)
    SELECT round(corr(a, b), 6) AS genotypes_robustness, round(corr(a, c), 6) AS genotypes_evolvability, round(corr(b, c), 6) AS robustness_evolvability, count(*) AS networks FROM means""",
    "draw_statistics": f"""WITH {_columns(3, 2)}, {_neutral(3)}, {_DRAWS}
    SELECT l_orderkey, l_linenumber, a.n_cols * b.n_cols * c.n_cols AS genotype_count, round((a.neutral_mean + b.neutral_mean + c.neutral_mean) / 36, 9) AS robustness_mean,
      round(sqrt(a.neutral_var + b.neutral_var + c.neutral_var) / 36, 9) AS robustness_std, a.evolvability + b.evolvability + c.evolvability AS evolvability
    FROM draws JOIN table_ AS a ON a.tt = f_1 JOIN table_ AS b ON b.tt = f_2 JOIN table_ AS c ON c.tt = f_3""",
    # published: orbits of threshold functions, realizable prefixes, bounds of weights
    "function_orbits": _counts("orbits", [2, 4, 10, 36, 224], 1),
    "realizable_prefixes": _counts("prefixes", [2, 4, 6, 12, 18], 2),
    "vector_counts": _counts("vectors", [2, 4, 10, 36, 202], 1),
}
ORACLES["parsed_attractor_text"] = ORACLES["draw_attractors"]
# networks that rows draw in the place of all
ORACLES["attractor_histogram_of_draws"] = ORACLES["attractor_histogram_d3"].replace(_ALL, _DRAWS)
ORACLES["spearman_of_statistics_of_draws"] = ORACLES["spearman_of_statistics_d3"].replace(f"{_neutral(3)},", f"{_neutral(3)}, {_DRAWS},").replace("FROM table_ AS a, table_ AS b, table_ AS c)", "FROM networks JOIN table_ AS a ON a.tt = f_1 JOIN table_ AS b ON b.tt = f_2 JOIN table_ AS c ON c.tt = f_3)")
