"""Queries over function tables and networks."""

from __future__ import annotations

from itertools import permutations

from ..functions import bits
from ..functions.dialect import Dialect
from ..operators import decomposition as dec
from ..operators import dynamics as dyn
from ..operators import networks as net
from ..operators import sbf
from ..sources import scans
from .registry import over_draws, sql

F3 = ["f_1", "f_2", "f_3"]


def drawn(q: Dialect) -> str:
    """Networks of 3 nodes that lineitem's rows draw: each key picks a function."""
    rows = f"(SELECT l_orderkey, l_linenumber, l_orderkey % 32 AS a, l_partkey % 32 AS b, l_suppkey % 32 AS c FROM {q.table('lineitem')})"
    return scans.drawn_networks(rows, sbf.functions(q, 3), ["draw.a", "draw.b", "draw.c"])


def drawn_once(q: Dialect) -> str:
    """The different networks among them: all work after this is done once per network."""
    return f"(SELECT DISTINCT f_1, f_2, f_3 FROM {drawn(q)} AS d)"


def drawn_pairs(q: Dialect) -> str:
    """Networks of 2 nodes that orders' rows draw."""
    rows = f"(SELECT o_orderkey, o_orderkey % 6 AS a, o_custkey % 6 AS b FROM {q.table('orders')})"
    return scans.drawn_networks(rows, sbf.functions(q, 2), ["draw.a", "draw.b"])


def every(q: Dialect, d: int) -> str:
    if q.drawn and d == 3:
        return drawn_once(q)
    return scans.all_networks(sbf.functions(q, d), d)


def vector(q: Dialect, code: str, d: int) -> str:
    text = bits.vector_text(code, d, q.div)
    return text if q.name == "spark" else text.replace("AS STRING", "AS VARCHAR")


# --- scans and function tables


@sql
def weight_scan_d3(q):
    return f"SELECT id, w_1, w_2, w_3, tt FROM {scans.weights(q, 3)} AS w"


@sql
def state_scan_d3(q):
    return f"SELECT CAST(s AS BIGINT) AS s, {' || '.join(f'''CASE WHEN (s & {1 << i}) <> 0 THEN '1' ELSE '0' END''' for i in (2, 1, 0))} AS label FROM {scans.states(3)} AS s"


@sql
def face_scan_d4(q):
    return f"SELECT CAST(fixed AS BIGINT) AS fixed, CAST(fixed_values AS BIGINT) AS fixed_values, CAST(dim AS BIGINT) AS dim, mask, CASE WHEN dim BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS proper FROM {scans.faces(4)} AS f"


@sql
def vector_scan(q):
    parts = [f"SELECT CAST({d} AS BIGINT) AS d, count(*) AS vectors, CAST(sum({' + '.join(f'v_{k}' for k in range(d + 1))}) AS BIGINT) AS leaves FROM {scans.vectors(d)} AS v" for d in (1, 2, 3, 4, 5)]
    return " UNION ALL ".join(parts)


@sql
def vector_counts(q):
    """Vectors of each size; the published counts are the oracle."""
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, count(*) AS vectors FROM {scans.vectors(d)} AS v" for d in (1, 2, 3, 4, 5))


@sql
def laurent_splits_d4(q):
    """Each vector of 4 nodes as a sum of two of 3, the left one not below the right: what a first control node can part."""
    pair_ = " AND ".join([*(f"v.v_{k} = a.v_{k} + b.v_{k}" for k in range(4)), "v.v_4 = 0"])
    code = " + ".join(f"{{0}}.v_{k} * {9 ** k}" for k in range(4))
    names = ", ".join(f"CAST({t}.v_{k} AS BIGINT) AS {n}_{k}" for t, n in (("v", "v"), ("a", "left"), ("b", "right")) for k in range(3, -1, -1))
    return f"SELECT {names} FROM {scans.vectors(4)} AS v JOIN {scans.vectors(3)} AS a ON a.v_0 <= v.v_0 JOIN {scans.vectors(3)} AS b ON {pair_} AND {code.format('a')} >= {code.format('b')}"


@sql
def tree_shapes_by_vector(q):
    """Binary shapes of control trees per vector of 4 nodes; every vector of the scan has one."""
    found = ", ".join(f"('{t}', {', '.join(map(str, v))})" for t, v in bits.shapes(4))
    names = ", ".join(f"v_{k}" for k in range(4, -1, -1))
    same = " AND ".join(f"v.v_{k} = s.v_{k}" for k in range(5))
    return f"SELECT {', '.join(f'CAST(v.v_{k} AS BIGINT) AS v_{k}' for k in range(4, -1, -1))}, count(s.shape) AS shapes FROM {scans.vectors(4)} AS v LEFT JOIN (SELECT * FROM (VALUES {found}) AS t(shape, {names})) AS s ON {same} GROUP BY {', '.join(f'v.v_{k}' for k in range(4, -1, -1))}"


@sql
def vector_list_d3(q):
    return f"SELECT CAST(v_3 AS BIGINT) AS v_3, CAST(v_2 AS BIGINT) AS v_2, CAST(v_1 AS BIGINT) AS v_1, CAST(v_0 AS BIGINT) AS v_0 FROM {scans.vectors(3)} AS v"


@sql
def function_counts(q):
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, count(DISTINCT tt) AS functions, count(*) AS columns FROM {scans.weights(q, d)} AS w" for d in (1, 2, 3, 4, 5))


@sql
def function_table_d3(q):
    return f"SELECT tt, n_cols, rep, round(neutral_mean, 9) AS neutral_mean, round(neutral_var, 9) AS neutral_var, evolvability, CAST(idx AS BIGINT) AS idx FROM {sbf.statistics(q, 3)} AS s"


@sql
def function_table_d4(q):
    return f"SELECT tt, n_cols, rep, round(neutral_mean, 9) AS neutral_mean, round(neutral_var, 9) AS neutral_var, evolvability FROM {sbf.statistics(q, 4)} AS s"


@sql
def function_neighbours_d3(q):
    return f"SELECT src, dst FROM {sbf.neighbours(q, 3)} AS n"


@sql
def neighbour_degrees_d4(q):
    return f"SELECT src, count(*) AS degree FROM {sbf.neighbours(q, 4)} AS n GROUP BY src"


@sql
def mutation_pairs_d2(q):
    return f"SELECT id, tt, to_id, to_tt, {q.ones(q.xor('tt', 'to_tt'))} AS changed FROM {sbf.mutants(q, 2)} AS m"


@sql
def minimal_weight_bounds(q):
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, CAST(bound AS BIGINT) AS bound, count(*) AS functions FROM {sbf.minimal_bounds(q, d)} AS b GROUP BY bound" for d in (1, 2, 3, 4, 5))


@sql
def weight_bound_of_each_size(q):
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, CAST(max(bound) AS BIGINT) AS bound FROM {sbf.minimal_bounds(q, d)} AS b" for d in (1, 2, 3, 4, 5))


@sql
def function_orbits(q):
    """Classes of functions under the orders of nodes, to 5 nodes; the published counts are the oracle."""
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, count(DISTINCT canonical) AS orbits FROM {sbf.canonical_forms(q, d)} AS f" for d in (1, 2, 3, 4, 5))


@sql
def function_canonical_forms_d3(q):
    return f"SELECT tt, {sbf.canonical('tt', 3)} AS canonical FROM {sbf.functions(q, 3)} AS f"


@sql
def realizable_prefixes(q):
    """Beginnings of d bits of functions with weights from -d to d, to 6 nodes; the published counts are the oracle."""
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, count(DISTINCT {net.prefix_of_weights(d)}) AS prefixes FROM {scans.columns(q, d, d)} AS w" for d in (2, 3, 4, 5, 6))


@sql
def fixed_function_models_d3(q):
    return f"SELECT models FROM {sbf.fixed_function_models(q, 3, [170, 204, 0])} AS m"


@sql
def fixed_function_networks_d3(q):
    return f"SELECT f_1, f_2, f_3 FROM {every(q, 3)} AS n WHERE f_3 = 0"


# --- all networks and drawn networks


@sql
def all_networks_d2(q):
    stats = net.with_statistics(dyn.with_attractors(q, every(q, 2), 2), sbf.statistics(q, 2), 2)
    return f"SELECT f_1, f_2, {q.bits('f_1', 4)} AS bits_1, genotype_count, round(robustness_mean, 9) AS robustness_mean, round(robustness_std, 9) AS robustness_std, evolvability, CAST(num_attractors AS BIGINT) AS num_attractors, round(cycle_len_msq, 9) AS cycle_len_msq FROM {stats} AS n"


@sql
def draw_statistics(q):
    """The full statistics of every drawn network, one row per draw."""
    stats = net.with_statistics(drawn_once(q), sbf.statistics(q, 3), 3)
    return f"SELECT d.l_orderkey, d.l_linenumber, s.genotype_count, round(s.robustness_mean, 9) AS robustness_mean, round(s.robustness_std, 9) AS robustness_std, s.evolvability FROM {drawn(q)} AS d JOIN {stats} AS s ON d.f_1 = s.f_1 AND d.f_2 = s.f_2 AND d.f_3 = s.f_3"


@sql
def draw_attractors(q):
    return f"SELECT f_1, f_2, f_3, CAST(num_attractors AS BIGINT) AS num_attractors, round(cycle_len_msq, 9) AS cycle_len_msq FROM {dyn.with_attractors(q, drawn_once(q), 3)} AS n"


@sql
def attractor_histogram_d3(q):
    return f"SELECT CAST(num_attractors AS BIGINT) AS num_attractors, round(cycle_len_msq, 9) AS cycle_len_msq, count(*) AS networks FROM {dyn.with_attractors(q, every(q, 3), 3)} AS n GROUP BY 1, 2"


@sql
def draw_successors(q):
    return f"SELECT f_1, f_2, f_3, s, CAST(t AS BIGINT) AS t FROM {q.explode_at(dyn.with_successors(q, drawn_once(q), 3) + ' AS n', 't_1', 8, 's', 't')}" if q.name == "spark" else f"SELECT f_1, f_2, f_3, s, CAST(t AS BIGINT) AS t FROM {q.explode_at(dyn.with_successors(q, drawn_once(q), 3), 't_1', 8, 's', 't')} AS x"


@sql
def successors_from_weights_d2(q):
    states = ", ".join(f"{bits.successor(['a.tt', 'b.tt'], s)} AS t_{s}" for s in range(4))
    return f"SELECT a.id AS id_1, b.id AS id_2, {states} FROM {scans.weights(q, 2)} AS a CROSS JOIN {scans.weights(q, 2)} AS b"


@sql
def draw_attractor_text(q):
    limits = f"(SELECT *, {dyn.limit_states(q, 3)} AS lim FROM {dyn.with_cycles(q, drawn_once(q), 3)} AS c)"
    text = dyn.attractor_text(q, 3)
    return f"SELECT f_1, f_2, f_3, {text if q.name == 'spark' else text.replace('AS STRING', 'AS VARCHAR')} AS dynamics FROM {limits} AS n"


def _parsed_attractors(q: Dialect) -> str:
    text = draw_attractor_text(q)
    if q.name == "spark":
        return f"SELECT f_1, f_2, f_3, CAST(size(cycles) AS BIGINT) AS num_attractors, round(aggregate(cycles, 0D, (s, c) -> s + power(size(split(c, ':')), 2)) / size(cycles), 9) AS cycle_len_msq FROM (SELECT f_1, f_2, f_3, array_distinct(split(dynamics, '[|]')) AS cycles FROM ({text}) AS d) AS c"
    return ""


@sql
def parsed_attractor_text(q):
    """Attractors read back from the legacy text of a network's dynamics; the oracle walks the states."""
    return _parsed_attractors(q)


@sql
def basin_sizes(q):
    """States that lead to each attractor, which its smallest state names."""
    limits = f"(SELECT f_1, f_2, {dyn.limit_states(q, 2)} AS lim FROM {dyn.with_cycles(q, every(q, 2), 2)} AS c)"
    rows = q.explode(limits + " AS n", "lim", "attractor") if q.name == "spark" else q.explode(limits, "lim", "attractor") + " AS x"
    return f"SELECT f_1, f_2, CAST(attractor AS BIGINT) AS attractor, count(*) AS basin FROM {rows} GROUP BY f_1, f_2, attractor"


@sql
def draw_bitstrings(q):
    one = f"(SELECT f_1, {q.bits('f_1', 8)} AS bits, {q.bits('f_2', 8)} AS other FROM {drawn_once(q)} AS d)"
    return f"SELECT bits, other, {q.number('bits')} AS back, count(*) AS networks FROM {one} AS b GROUP BY bits, other"


@sql
def genotype_total_d3(q):
    """The sum of all genotype counts is the number of weight matrices."""
    return f"SELECT CAST(sum(genotype_count) AS BIGINT) AS genotypes, max(genotype_count) AS largest, {q.median('genotype_count')} AS middle FROM {net.with_statistics(every(q, 3), sbf.statistics(q, 3), 3)} AS n"


@sql
def robustness_by_constants_d3(q):
    stats = net.with_statistics(every(q, 3), sbf.statistics(q, 3), 3)
    return f"SELECT CAST({net.constant_zeros(3)} AS BIGINT) AS constants, count(*) AS networks, round(min(robustness_mean), 6) AS least, round(max(robustness_mean), 6) AS most, round(avg(robustness_mean), 6) AS mean, round(avg(robustness_std), 6) AS mean_std FROM {stats} AS n GROUP BY 1"


@sql
def slices_of_first_function_d3(q):
    return f"SELECT {net.prefix('f_1', 3)} AS slice, count(*) AS networks FROM {every(q, 3)} AS n GROUP BY 1"


@sql
def prefix_slice_d3(q):
    return f"SELECT f_1, f_2, f_3 FROM {every(q, 3)} AS n WHERE {net.prefix('f_1', 3)} = '001' AND f_2 = 170"


@sql
def inhibitor_networks_d3(q):
    joins = " CROSS JOIN ".join(f"(SELECT tt AS f_{i} FROM {net.inhibitor_functions(q, 3, i)} AS i{i}) AS n{i}" for i in (1, 2, 3))
    return f"SELECT {vector(q, 'code', 3)} AS vector, count(*) AS networks FROM {dec.finest(f'(SELECT f_1, f_2, f_3 FROM {joins})', 3, True)} AS n GROUP BY 1"


@sql
def weight_keys_d3(q):
    """Per function the column with fewest weights, then smallest ones, then the first."""
    cols = f"(SELECT tt, id, {' + '.join(f'CASE WHEN w_{i} <> 0 THEN 1 ELSE 0 END' for i in (1, 2, 3))} AS used, abs(w_1) + abs(w_2) + abs(w_3) AS size, w_1 + w_2 + w_3 AS total FROM {scans.weights(q, 3)} AS w)"
    return f"SELECT tt, id, CAST(used AS BIGINT) AS used, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY tt ORDER BY used, size, id) AS place FROM {cols} AS c) AS r WHERE place = 1"


@sql
def weights_realize_functions(q):
    """Violations of the rule that a function's first column realizes it; there are none."""
    return f"SELECT count(*) AS checked, CAST(sum(CASE WHEN w.tt <> f.tt THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM {sbf.functions(q, 4)} AS f JOIN {scans.weights(q, 4)} AS w ON w.id = f.rep"


@sql
def nearest_columns_d3(q):
    """For every function, the column of weights nearest to that of the function before it."""
    cols = f"(SELECT f.idx, w.* FROM {sbf.functions(q, 3)} AS f JOIN {scans.weights(q, 3)} AS w ON w.id = f.rep)"
    far = " + ".join(f"abs(w.w_{i} - c.w_{i})" for i in (1, 2, 3))
    return f"SELECT tt, near_id, CAST(far AS BIGINT) AS far FROM (SELECT c.tt, w.id AS near_id, {far} AS far, row_number() OVER (PARTITION BY c.tt ORDER BY {far}, w.id) AS place FROM {cols} AS c CROSS JOIN {scans.weights(q, 3)} AS w WHERE w.tt <> c.tt) AS r WHERE place = 1"


@sql
def permuted_networks_d3(q):
    """Each drawn network under the rotation of its nodes."""
    p = (1, 2, 0)
    images = [sbf.permuted(f"f_{i + 1}", 3, p) for i in range(3)]
    placed = [images[p.index(j)] for j in range(3)]
    return f"SELECT f_1, f_2, f_3, {', '.join(f'{x} AS g_{j + 1}' for j, x in enumerate(placed))} FROM {drawn_once(q)} AS d"


@sql
def canonical_networks_d2(q):
    forms = []
    for p in permutations(range(2)):
        images = [sbf.permuted(f"f_{i + 1}", 2, p) for i in range(2)]
        forms.append(" * 16 + ".join(images[p.index(j)] for j in range(2)))
    return f"SELECT least({', '.join(forms)}) AS canonical, count(*) AS networks FROM {every(q, 2)} AS n GROUP BY 1"


# --- decomposition


@sql
def draw_decomposition_census(q):
    """Finest vectors of the drawn networks, found once per network and counted by draw."""
    found = dec.finest(f"(SELECT f_1, f_2, f_3, count(*) AS draws FROM {drawn(q)} AS d GROUP BY f_1, f_2, f_3)", 3)
    return f"SELECT {vector(q, 'code', 3)} AS vector, count(*) AS networks, CAST(sum(draws) AS BIGINT) AS draws FROM {found} AS n GROUP BY 1"


def pair(q: Dialect) -> str:
    """All networks of 3 nodes with both codes."""
    free, guarded = dec.finest(every(q, 3), 3, False, "free_code"), dec.finest(every(q, 3), 3, True, "guarded_code")
    return f"(SELECT a.f_1, a.f_2, a.f_3, a.free_code, b.guarded_code FROM {free} AS a JOIN {guarded} AS b ON a.f_1 = b.f_1 AND a.f_2 = b.f_2 AND a.f_3 = b.f_3)"


@sql
def decomposition_census_d3(q):
    return f"SELECT {vector(q, 'free_code', 3)} AS free_vector, {vector(q, 'guarded_code', 3)} AS guarded_vector, count(*) AS networks FROM {pair(q)} AS n GROUP BY 1, 2"


@sql
def draws_of_a_vector(q):
    """The drawn networks whose finest vector is <0,2,0,0>."""
    code = 2 * bits.leaf_code(3, 2)
    return f"SELECT f_1, f_2, f_3 FROM {dec.finest(drawn_once(q), 3)} AS n WHERE code = {code}"


@sql
def guarded_vectors_of_draws(q):
    return f"SELECT f_1, f_2, f_3, {vector(q, 'code', 3)} AS vector FROM {dec.finest(drawn_once(q), 3, True)} AS n"


@sql
def tree_counts_d3(q):
    """Labelled trees of all networks, by a count over faces."""
    free, guarded = (dec.finest(every(q, 3), 3, g, "trees", "count") for g in (False, True))
    return f"SELECT 'free' AS mode, CAST(sum(trees) AS BIGINT) AS trees, max(trees) AS most FROM {free} AS a UNION ALL SELECT 'guarded' AS mode, CAST(sum(trees) AS BIGINT) AS trees, max(trees) AS most FROM {guarded} AS b"


@sql
def labelled_trees_d2(q):
    return f"SELECT f_1, f_2, tree, CAST(v_2 AS BIGINT) AS v_2, CAST(v_1 AS BIGINT) AS v_1, CAST(v_0 AS BIGINT) AS v_0 FROM {dec.decomposed(every(q, 2), 2, True)} AS t"


@sql
def labelled_trees_by_vector_d3(q):
    """Rows, networks and more finely decomposable networks per vector, guarded."""
    found = dec.decomposed(dec.finest(every(q, 3), 3, True), 3, True)
    finer = "CASE WHEN leaf_sum < " + q.div("code", bits.code_base(3) ** 4) + " THEN 1 ELSE 0 END"
    each = f"(SELECT f_1, f_2, f_3, v_3, v_2, v_1, v_0, count(*) AS trees, max({finer}) AS finer FROM {found} AS t GROUP BY f_1, f_2, f_3, v_3, v_2, v_1, v_0)"
    return f"SELECT CAST(v_3 AS BIGINT) AS v_3, CAST(v_2 AS BIGINT) AS v_2, CAST(v_1 AS BIGINT) AS v_1, CAST(v_0 AS BIGINT) AS v_0, CAST(sum(trees) AS BIGINT) AS trees, count(*) AS networks, CAST(sum(finer) AS BIGINT) AS finer FROM {each} AS e GROUP BY 1, 2, 3, 4"


@sql
def free_trees_by_vector_d3(q):
    return f"SELECT CAST(v_3 AS BIGINT) AS v_3, CAST(v_2 AS BIGINT) AS v_2, CAST(v_1 AS BIGINT) AS v_1, CAST(v_0 AS BIGINT) AS v_0, count(*) AS trees FROM {dec.decomposed(every(q, 3), 3)} AS t GROUP BY 1, 2, 3, 4"


@sql
def draw_trees(q):
    return f"SELECT tree, count(*) AS networks, CAST(length(tree) - length(replace(tree, '*', '')) AS BIGINT) AS leaves FROM {dec.decomposed(drawn_once(q), 3)} AS t GROUP BY tree"


@sql
def fixed_tree_d3(q):
    """Networks of the one tree 3[*,*]: guarded or not, with equal or different halves."""
    t = "3[*,*]"
    parts = [f"SELECT '{m}' AS mode, CASE WHEN {dec.distinct_halves(3, 3)} THEN 'different' ELSE 'equal' END AS halves, count(*) AS networks FROM {dec.decomposed(every(q, 3), 3, g, [t])} AS {m} GROUP BY 2" for m, g in (("guarded_mode", True), ("free_mode", False))]
    return " UNION ALL ".join(parts)


@sql
def fixed_tree_difference_d3(q):
    t = ["3[*,*]"]
    free, guarded = (f"SELECT f_1, f_2, f_3 FROM {dec.decomposed(every(q, 3), 3, g, t)} AS x" for g in (False, True))
    return f"SELECT count(*) AS free_only FROM ({free} EXCEPT {guarded}) AS e"


@sql
def tree_in_any_order_d3(q):
    """Networks that admit the tree 3[*,*] under some order of the nodes, guarded or not."""
    trees = [f"{n}[*,*]" for n in (1, 2, 3)]
    return " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS networks FROM (SELECT DISTINCT f_1, f_2, f_3 FROM {dec.decomposed(every(q, 3), 3, g, trees)} AS x) AS y" for m, g in (("guarded", True), ("free", False)))


@sql
def decomposable_networks(q):
    """Guarded networks with a split at the root, counted without listing them, for 1 to 4 nodes."""
    parts = []
    for d in (1, 2, 3, 4):
        parts.append(f"SELECT CAST({d} AS BIGINT) AS d, CAST(decomposable AS DECIMAL(38,0)) AS guarded FROM {dec.guarded_decomposable_count(q, sbf.functions(q, d), d)} AS g")
    return " UNION ALL ".join(parts)


@sql
def trivial_share(q):
    """The share of networks without a control node at the root."""
    return " UNION ALL ".join(f"SELECT CAST({d} AS BIGINT) AS d, round(100 * power((count(*) - 1) / CAST(count(*) AS DOUBLE), {d}), 4) AS trivial_percent FROM {sbf.functions(q, d)} AS f" for d in (3, 4, 5))


@sql
def trivial_share_of_draws(q):
    return f"SELECT round(100 * avg(CASE WHEN code = {bits.leaf_code(3, 3)} THEN 1E0 ELSE 0E0 END), 4) AS trivial_percent FROM {dec.finest(drawn_once(q), 3)} AS n"


@sql
def free_only_networks_d3(q):
    """Networks that only the free mode decomposes."""
    trivial = bits.leaf_code(3, 3)
    return f"SELECT count(*) AS networks, CAST(sum(CASE WHEN f_3 = 170 THEN 1 ELSE 0 END) AS BIGINT) AS with_170 FROM {pair(q)} AS n WHERE free_code <> {trivial} AND guarded_code = {trivial}"


@sql
def greedy_trees_d3(q):
    """The greedy tree has as many leaves as the finest vector."""
    found = dec.greedy_leaves(f"(SELECT f_1, f_2, f_3, code FROM {dec.finest(every(q, 3), 3)} AS x)", 3)
    return f"SELECT CAST(greedy_leaves AS BIGINT) AS greedy_leaves, {q.div('code', bits.code_base(3) ** 4)} AS finest_leaves, count(*) AS networks FROM {found} AS n GROUP BY 1, 2"


@sql
def control_tests_agree_d3(q):
    """Control by weights and by truth tables, over every column, face and node: no case differs."""
    terms = []
    for face in bits.faces(3):
        for node in face.free:
            by_table = f"(tt & {face.mask}) = {bits.projection(3, node) & face.mask}"
            terms.append(f"SELECT {face.dim} AS dim, count(*) AS cases, CAST(sum(CASE WHEN {dec.weight_control(3, face, node, ['w_1', 'w_2', 'w_3'])} THEN 1 ELSE 0 END) AS BIGINT) AS control, CAST(sum(CASE WHEN {dec.weight_control(3, face, node, ['w_1', 'w_2', 'w_3'])} <> ({by_table}) THEN 1 ELSE 0 END) AS BIGINT) AS differ FROM {scans.weights(q, 3)} AS w")
    return f"SELECT CAST(dim AS BIGINT) AS dim, CAST(sum(cases) AS BIGINT) AS cases, CAST(sum(control) AS BIGINT) AS control, CAST(sum(differ) AS BIGINT) AS differ FROM ({' UNION ALL '.join(terms)}) AS t GROUP BY 1"


@sql
def realizable_faces_of_draws(q):
    named = f"(SELECT f_1, f_2, f_3, valid FROM {dec.with_valid_faces(drawn_once(q), 3)} AS v)"
    return f"SELECT {q.ones('valid')} AS realizable_faces, count(*) AS networks FROM {named} AS n GROUP BY 1"


@sql
def invariant_faces_d3(q):
    """Networks with an invariant proper face that no control tree splits; whether such faces cover the cube."""
    found = dec.finest(f"(SELECT *, {dyn.invariant_faces(3)} AS inner_faces, {dyn.covered_states(3)} AS covered FROM {every(q, 3)} AS x)", 3)
    return f"SELECT CASE WHEN code = {bits.leaf_code(3, 3)} THEN 1 ELSE 0 END AS trivial, CASE WHEN inner_faces > 0 THEN 1 ELSE 0 END AS with_face, CASE WHEN covered = 255 THEN 1 ELSE 0 END AS all_states, count(*) AS networks FROM {found} AS n GROUP BY 1, 2, 3"


@sql
def autonomous_nodes_of_draws(q):
    return f"SELECT f_1, f_2, f_3, CAST({dyn.autonomous_sets(3)} AS BIGINT) AS autonomous_sets, CASE WHEN {dyn.autonomous(3, (1, 2))} THEN 1 ELSE 0 END AS first_two FROM {drawn_once(q)} AS d"


@sql
def closed_control_d3(q):
    """Networks with 3[*,*] whose halves no transition leaves, with different halves: all fixed-tree networks have that."""
    root = bits.Face(3, 0, 0)
    closed = " AND ".join(root.with_node(3, v).closed(F3) for v in (0, 1))
    return f"SELECT CASE WHEN {closed} THEN 1 ELSE 0 END AS closed, count(*) AS networks FROM {dec.decomposed(every(q, 3), 3, True, ['3[*,*]'])} AS n WHERE {dec.distinct_halves(3, 3)} GROUP BY 1"


@sql
def undecomposable_leaves_d3(q):
    """Networks of the tree 3[*,*] whose leaves have no control node: for them it is the exact tree."""
    root = bits.Face(3, 0, 0)
    inner = " OR ".join(root.with_node(3, v).invariant(F3, n) for v in (0, 1) for n in (1, 2))
    return f"SELECT CASE WHEN {inner} THEN 'refinable' ELSE 'exact' END AS kind, count(*) AS networks FROM {dec.decomposed(every(q, 3), 3, False, ['3[*,*]'])} AS n GROUP BY 1"


@sql
def unrealizable_faces_d3(q):
    """Networks with a face that weights within the bound can't realize."""
    every_face = (1 << 27) - 1
    return f"SELECT CASE WHEN valid = {every_face} THEN 1 ELSE 0 END AS all_realizable, count(*) AS networks FROM (SELECT valid FROM {dec.with_valid_faces(every(q, 3), 3)} AS v) AS n GROUP BY 1"


@sql
def invariant_functions_d3(q):
    """Per face and node, the functions that keep the node there."""
    parts = [f"SELECT {i} AS face, {n} AS node, tt FROM {sbf.functions(q, 3)} AS f WHERE (tt & {f.mask}) = {bits.projection(3, n) & f.mask}" for i, f in enumerate(bits.faces(3)) for n in f.free]
    return f"SELECT CAST(face AS BIGINT) AS face, CAST(node AS BIGINT) AS node, count(*) AS functions, min(tt) AS least, max(tt) AS most FROM ({' UNION ALL '.join(parts)}) AS p GROUP BY 1, 2"


@sql
def core_networks_d3(q):
    """Networks of at least two leaves, with the best sum of leaves over their trees."""
    found = f"(SELECT f_1, f_2, f_3, max(leaf_sum) AS leaves, count(*) AS trees FROM {dec.decomposed(every(q, 3), 3)} AS t WHERE leaf_sum >= 2 GROUP BY f_1, f_2, f_3)"
    return f"SELECT CAST(leaves AS BIGINT) AS leaves, count(*) AS networks, CAST(sum(trees) AS BIGINT) AS trees FROM {found} AS c GROUP BY 1"


@sql
def capped_rows_per_vector(q):
    """At most 5 networks per vector, in order."""
    numbered = f"(SELECT f_1, f_2, f_3, code, row_number() OVER (PARTITION BY code ORDER BY f_1, f_2, f_3) AS place FROM {dec.finest(drawn_once(q), 3)} AS n)"
    return f"SELECT {vector(q, 'code', 3)} AS vector, f_1, f_2, f_3 FROM {numbered} AS p WHERE place <= 5"


@sql
def finest_row_per_network(q):
    """Of the trees of each drawn network, one of most leaves: ties go to the finer vector, then the text."""
    ranked = f"(SELECT f_1, f_2, f_3, tree, leaf_sum, row_number() OVER (PARTITION BY f_1, f_2, f_3 ORDER BY leaf_sum DESC, v_0 DESC, v_1 DESC, v_2 DESC, tree) AS place FROM {dec.decomposed(drawn_once(q), 3)} AS t)"
    return f"SELECT f_1, f_2, f_3, tree, CAST(leaf_sum AS BIGINT) AS leaf_sum FROM {ranked} AS r WHERE place = 1"


@sql
def finest_ties_d3(q):
    """Networks with two vectors of the largest sum of leaves: none."""
    found = f"(SELECT f_1, f_2, f_3, leaf_sum, v_3, v_2, v_1, v_0 FROM {dec.decomposed(every(q, 3), 3)} AS t)"
    top = f"(SELECT *, max(leaf_sum) OVER (PARTITION BY f_1, f_2, f_3) AS most FROM {found} AS f)"
    return f"SELECT count(*) AS networks, CAST(coalesce(sum(CASE WHEN kinds > 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS ties FROM (SELECT f_1, f_2, f_3, count(DISTINCT v_3 * 1000000 + v_2 * 10000 + v_1 * 100 + v_0) AS kinds FROM {top} AS t WHERE leaf_sum = most GROUP BY f_1, f_2, f_3) AS k"


@sql
def numbered_networks(q):
    """Dense numbers of the drawn networks in order of their functions."""
    packed = "f_1 * 65536 + f_2 * 256 + f_3"
    return f"SELECT f_1, f_2, f_3, count(*) AS draws, CAST(rank() OVER (ORDER BY {packed}) AS BIGINT) AS number FROM {drawn(q)} AS d GROUP BY f_1, f_2, f_3"


@sql
def first_seen_numbers(q):
    """Dense numbers of the drawn networks in the order in which lineitem's rows, by key, first draw them."""
    seen = f"(SELECT f_1, f_2, f_3, min(l_orderkey * 100 + l_linenumber) AS first_row FROM {drawn(q)} AS d GROUP BY f_1, f_2, f_3)"
    return f"SELECT f_1, f_2, f_3, CAST(row_number() OVER (ORDER BY first_row, f_1, f_2, f_3) - 1 AS BIGINT) AS number FROM {seen} AS s"


@sql
def quota_rows_by_prefix(q):
    """Up to 50 networks per vector; of a vector with more, each beginning of the first function has an equal quota, 1 at
    least."""
    begin = net.prefix("f_1", 3)
    found = f"(SELECT f_1, f_2, f_3, code, {begin} AS slice FROM {dec.finest(drawn_once(q), 3)} AS n)"
    sizes = f"(SELECT code, count(*) AS n, count(DISTINCT slice) AS slices FROM {found} AS s GROUP BY code)"
    placed = f"(SELECT f.*, z.n, z.slices, row_number() OVER (PARTITION BY f.code, f.slice ORDER BY f_1, f_2, f_3) AS place FROM {found} AS f JOIN {sizes} AS z ON f.code = z.code)"
    return f"SELECT {vector(q, 'code', 3)} AS vector, slice, f_1, f_2, f_3 FROM {placed} AS p WHERE n <= 50 OR place <= greatest(1, {q.div('50', 'slices')})"


@sql
def top_decomposed_draws(q):
    """The 20 drawn networks of most leaves."""
    leaves = q.div("code", bits.code_base(3) ** 4)
    return f"SELECT f_1, f_2, f_3, leaves FROM (SELECT f_1, f_2, f_3, {leaves} AS leaves FROM {dec.finest(drawn_once(q), 3)} AS n) AS l ORDER BY leaves DESC, f_1, f_2, f_3 LIMIT 20"


@sql
def canonical_order_of_trees(q):
    """Trees of the networks of 2 nodes numbered from coarse to fine vectors."""
    return f"SELECT f_1, f_2, tree, CAST(row_number() OVER (ORDER BY -v_2, -v_1, -v_0, tree, f_1, f_2) AS BIGINT) AS place FROM {dec.decomposed(every(q, 2), 2, True)} AS t"


@sql
def unused_minimal_networks(q):
    """Per vector the first drawn network that the draws of orders, padded with a constant, don't use."""
    used = f"(SELECT DISTINCT f_1 * 17 AS f_1, f_2 * 17 AS f_2, CAST(0 AS BIGINT) AS f_3 FROM {drawn_pairs(q)} AS p)"
    free = f"(SELECT n.* FROM {dec.finest(drawn_once(q), 3)} AS n LEFT JOIN {used} AS u ON n.f_1 = u.f_1 AND n.f_2 = u.f_2 AND n.f_3 = u.f_3 WHERE u.f_1 IS NULL)"
    return f"SELECT {vector(q, 'code', 3)} AS vector, f_1, f_2, f_3 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY f_1 + f_2 + f_3, f_1, f_2) AS place FROM {free} AS f) AS r WHERE place = 1"


@sql
def legend_order(q):
    return f"SELECT {vector(q, 'code', 3)} AS vector, CAST(row_number() OVER (ORDER BY code) AS BIGINT) AS place FROM (SELECT DISTINCT code FROM {dec.finest(drawn_once(q), 3)} AS n) AS c"


@sql
def sorted_content_hash(q):
    """A digest of the networks of 2 nodes in canonical order."""
    line = "CAST(f_1 AS STRING) || ',' || CAST(f_2 AS STRING)" if q.name == "spark" else "CAST(f_1 AS VARCHAR) || ',' || CAST(f_2 AS VARCHAR)"
    return f"SELECT {q.sha256(q.joined(q.sorted_list('line'), chr(10)))} AS digest, count(*) AS lines FROM (SELECT {line} AS line FROM {every(q, 2)} AS n) AS l"


# --- sets


@sql
def difference_of_draws(q):
    """Networks that lineitem's draws of two keys find and those of swapped keys don't, and those that both find."""
    swapped = f"(SELECT f_2 AS f_1, f_1 AS f_2, f_3 FROM {drawn_once(q)} AS s)"
    return f"SELECT 'only' AS part, count(*) AS networks FROM (SELECT f_1, f_2, f_3 FROM {drawn_once(q)} AS a EXCEPT SELECT f_1, f_2, f_3 FROM {swapped} AS b) AS e UNION ALL SELECT 'both' AS part, count(*) AS networks FROM (SELECT f_1, f_2, f_3 FROM {drawn_once(q)} AS a INTERSECT SELECT f_1, f_2, f_3 FROM {swapped} AS b) AS i"


@sql
def equal_sets_d3(q):
    """Networks with a labelled tree are those with a finest vector that isn't trivial: both differences are empty."""
    a = f"SELECT f_1, f_2, f_3 FROM {dec.finest(every(q, 3), 3)} AS n WHERE code <> {bits.leaf_code(3, 3)}"
    b = f"SELECT DISTINCT f_1, f_2, f_3 FROM {dec.decomposed(every(q, 3), 3)} AS t WHERE leaf_sum > 1"
    return f"SELECT (SELECT count(*) FROM ({a} EXCEPT {b}) AS x) AS left_only, (SELECT count(*) FROM ({b} EXCEPT {a}) AS y) AS right_only"


@sql
def union_of_slices(q):
    parts = " UNION ALL ".join(f"SELECT f_1, f_2, f_3 FROM {drawn_once(q)} AS d{p} WHERE {net.prefix('f_1', 2)} = '{p}'" for p in ("00", "01"))
    return f"SELECT count(*) AS networks, count(DISTINCT f_1) AS first_functions FROM ({parts}) AS u"


@sql
def labels_required_d3(q):
    """Networks whose trees of most leaves all take different labels at one depth, by vector."""
    def one_label(t: bits.Tree) -> bool:
        return all(len({n for f, n in t.splits if f.dim == k}) <= 1 for k in (1, 2, 3))

    v = "f_1, f_2, f_3, v_3, v_2, v_1, v_0"
    uniform = ", ".join(f"'{t.text}'" for t in bits.trees(bits.Face(3, 0, 0)) if one_label(t))
    top = f"(SELECT *, max(leaf_sum) OVER (PARTITION BY f_1, f_2, f_3) AS most FROM {dec.decomposed(every(q, 3), 3)} AS t)"
    found = f"(SELECT {v}, max(CASE WHEN tree IN ({uniform}) THEN 1 ELSE 0 END) AS one_label FROM {top} AS t WHERE leaf_sum = most GROUP BY {v})"
    return f"SELECT CAST(v_3 AS BIGINT) AS v_3, CAST(v_2 AS BIGINT) AS v_2, CAST(v_1 AS BIGINT) AS v_1, CAST(v_0 AS BIGINT) AS v_0, count(*) AS networks FROM {found} AS f WHERE one_label = 0 GROUP BY 1, 2, 3, 4"


# --- analytics


def _ranked(q: Dialect, relation: str, x: str) -> str:
    """Average ranks: ties share the mean of their places."""
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@sql
def spearman_of_statistics_d3(q):
    """Rank correlation of genotype counts and robustness over all networks."""
    stats = f"(SELECT genotype_count, round(robustness_mean, 9) AS r, evolvability FROM {net.with_statistics(every(q, 3), sbf.statistics(q, 3), 3)} AS n)"
    ranks = f"(SELECT CAST({_ranked(q, '', 'genotype_count')} AS DOUBLE) AS a, CAST({_ranked(q, '', 'r')} AS DOUBLE) AS b, CAST({_ranked(q, '', 'evolvability')} AS DOUBLE) AS c FROM {stats} AS s)"
    return f"SELECT round(corr(a, b), 6) AS genotypes_robustness, round(corr(a, c), 6) AS genotypes_evolvability, round(corr(b, c), 6) AS robustness_evolvability, count(*) AS networks FROM {ranks} AS r"


@sql
def spearman_robustness_evolvability_d2(q):
    stats = f"(SELECT round(robustness_mean, 9) AS r, evolvability FROM {net.with_statistics(every(q, 2), sbf.statistics(q, 2), 2)} AS n)"
    ranks = f"(SELECT CAST({_ranked(q, '', 'r')} AS DOUBLE) AS b, CAST({_ranked(q, '', 'evolvability')} AS DOUBLE) AS c FROM {stats} AS s)"
    return f"SELECT round(corr(b, c), 6) AS correlation FROM {ranks} AS r"


def _scatter(q: Dialect) -> str:
    stats = net.with_statistics(f"(SELECT f_1, f_2, f_3, code FROM {dec.finest(drawn_once(q), 3)} AS x)", sbf.statistics(q, 3), 3)
    return f"(SELECT *, round(robustness_mean, 6) AS x, evolvability AS y FROM {stats} AS s)"


@sql
def scatter_groups(q):
    """Points of a scatter plot: networks of one place and vector, with sizes and spreads."""
    return f"SELECT x, y, {vector(q, 'code', 3)} AS vector, count(*) AS networks, CAST(sum(genotype_count) AS BIGINT) AS genotypes, round(avg(robustness_std), 6) AS mean_std FROM {_scatter(q)} AS p GROUP BY x, y, code"


@sql
def visible_vectors(q):
    """Of the vectors at one place of the plot, the one drawn on top: of fewest networks, then most leaves."""
    groups = f"(SELECT x, y, code, count(*) AS n FROM {_scatter(q)} AS p GROUP BY x, y, code)"
    return f"SELECT x, y, {vector(q, 'code', 3)} AS vector, n FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n, code DESC) AS place FROM {groups} AS g) AS r WHERE place = 1"


@sql
def floor_by_largest_face(q):
    """The least spread per dimension of the largest leaf."""
    dim = "CASE " + " ".join(f"WHEN {bits.digit('code', 3, k, q.div)} > 0 THEN {k}" for k in (3, 2, 1)) + " ELSE 0 END"
    return f"SELECT CAST(dim AS BIGINT) AS dim, round(min(robustness_std), 9) AS least_std, count(*) AS networks FROM (SELECT {dim} AS dim, robustness_std FROM {_scatter(q)} AS p) AS d GROUP BY 1"


@sql
def vector_statistics_of_draws(q):
    return f"SELECT {vector(q, 'code', 3)} AS vector, count(*) AS networks, round(avg(robustness_mean), 9) AS robustness, round(avg(evolvability), 6) AS evolvability, max(genotype_count) AS most_genotypes, {q.median('evolvability')} AS middle FROM {_scatter(q)} AS p GROUP BY code"


@sql
def network_rows_valid(q):
    """Rows whose bitstrings have one bit per state."""
    rows = f"(SELECT {q.bits('f_1', 8)} AS a, CASE WHEN f_2 = 0 THEN '0' ELSE {q.bits('f_2', 8)} END AS b FROM {drawn_once(q)} AS d)"
    return f"SELECT CASE WHEN length(a) = 8 AND length(b) = 8 THEN 1 ELSE 0 END AS valid, count(*) AS networks FROM {rows} AS r GROUP BY 1"


# --- the same over the networks that are drawn

for _text in (
    fixed_function_networks_d3, attractor_histogram_d3, genotype_total_d3, robustness_by_constants_d3, slices_of_first_function_d3, prefix_slice_d3, decomposition_census_d3, tree_counts_d3,
    labelled_trees_by_vector_d3, free_trees_by_vector_d3, fixed_tree_d3, fixed_tree_difference_d3, tree_in_any_order_d3, free_only_networks_d3, greedy_trees_d3, invariant_faces_d3, closed_control_d3,
    undecomposable_leaves_d3, unrealizable_faces_d3, core_networks_d3, finest_ties_d3, equal_sets_d3, labels_required_d3, spearman_of_statistics_d3,
):
    over_draws(_text)
