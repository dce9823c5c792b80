"""Parent-child links to full hierarchies.

A scope (a file, say) holds whole components, so scopes of bounded size are co-located as they are, by one shuffle, and
their links are resolved where they lie. The links of larger scopes are resolved by joins, their components found by
pointer doubling and then co-located one by one. Each component goes through an iterative depth-first traversal with node
colouring. Components above the bound are never put into one task: their rows take root, depth, path, order and loop
members from the doubled pointers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import changed, pinned, whole_groups

#: Most rows that are traversed in one task.
MAX_ROWS = 200_000

RESULT = "parent_id long, root_id long, depth int, names array<string>, n_descendants long, enter long, leave long, status string, cycle array<long>, path_ids array<long>"


def _beside(a: DataFrame, b: DataFrame, scope: list[str], on: str, how: str = "inner") -> DataFrame:
    """Joins on equal scopes (null is a value like any other) and the condition `on`; b brings no other names of a."""
    for i, k in enumerate(scope):
        b = b.withColumnRenamed(k, f"_s{i}")
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(scope)]
    return a.join(b, [*same, F.expr(on)], how).drop(*(f"_s{i}" for i in range(len(scope))))


def resolve_links(nodes: DataFrame, scope: list[str], id_: str, parent: str, name: str, container: str) -> DataFrame:
    """One row per (scope, id) with _parent: the id of the parent in the same scope, or null.

    The parent is the row with that id; where parent is null and container is not, the row with that name (the least id,
    if several have it). Links to nothing are null. Of rows that repeat an id, the greatest (parent, container, name)
    stays, so a null loses against a value; rows with a null id are dropped.
    """
    one = (
        nodes.where(F.col(id_).isNotNull())
        .groupBy(*scope, F.col(id_).cast("long").alias("_id"))
        .agg(F.max(F.struct(F.col(parent).cast("long").alias("p"), F.col(container).alias("c"), F.col(name).alias("n"))).alias("v"))
        .select(*scope, "_id", F.col("v.p").alias("_p"), F.col("v.c").alias("_c"), F.col("v.n").alias("_name"))
    )
    named = one.where("_name is not null").groupBy(*scope, F.col("_name").alias("_n")).agg(F.min("_id").alias("_by_name"))
    wanted = _beside(one.withColumn("_call", F.expr("if(_p is null, _c, null)")), named, scope, "_call = _n", "left").select(*scope, "_id", "_name", F.coalesce("_p", "_by_name").alias("_want"))
    there = one.select(*scope, F.col("_id").alias("_there"))
    return _beside(wanted, there, scope, "_want = _there", "left").select(*scope, "_id", "_name", F.col("_there").alias("_parent"))


def pointer_jump(links: DataFrame, scope: list[str], paths: bool = False) -> DataFrame:
    """Doubles the pointers of (scope, _id, _name, _parent) until all rows reach a root or are known to be on or below a loop.

    Gives _root, _depth, _loop, _ptr, _label (equal within a component) and, with paths, _anc (ids from the row up, the
    root last) and _names; with paths there must be no loops. Each round is one join, written to the shared folder.
    """
    first = links.select(
        *scope, "_id", "_name", "_parent", F.coalesce("_parent", "_id").alias("_ptr"), F.expr("if(_parent is null, 0L, 1L)").alias("_depth"),
        F.col("_parent").isNull().alias("_done"), F.col("_id").alias("_label"),
        *([F.expr("array(_id)").alias("_anc"), F.expr("array(coalesce(_name, ''))").alias("_names")] if paths else []),
    )
    state = pinned(first)
    # no way is longer than its scope has rows
    rows, step = state.groupBy(*scope).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0, 1
    carried = ["_ptr", "_depth", "_done", "_label", *(["_anc", "_names"] if paths else [])]
    while state.where("not _done").limit(1).count() and step <= 2 * rows:
        up = state.select(*scope, F.col("_id").alias("_uid"), *[F.col(c).alias(f"_u{c}") for c in carried])
        moved = _beside(state.where("not _done"), up, scope, "_ptr = _uid").select(
            *scope, "_id", "_name", "_parent", F.col("_u_ptr").alias("_ptr"), F.expr("_depth + _u_depth").alias("_depth"), F.col("_u_done").alias("_done"), F.least("_label", "_u_label").alias("_label"),
            *([F.concat("_anc", "_u_anc").alias("_anc"), F.concat("_names", "_u_names").alias("_names")] if paths else []),
        )
        state, step = pinned(state.where("_done").unionByName(moved)), step * 2
    tip = state.select(*scope, F.col("_id").alias("_uid"), F.col("_label").alias("_tip"))
    out = _beside(state, tip, scope, "_ptr = _uid")
    ends = [F.expr(x) for x in ("if(_done, _ptr, null) as _root", "if(_done, _depth, null) as _depth", "not _done as _loop", "if(_done, _ptr, _tip) as _label")]
    return out.select(*scope, "_id", "_name", "_parent", "_ptr", *ends, *(["_anc", "_names"] if paths else []))


def _resolved(ids: list, parents: list, names: list, containers: list) -> list:
    """The parent of each row of one scope, as resolve_links() finds it. The ids are in order and differ."""
    there = set(ids)
    by_name: dict = {}
    for i, n in zip(ids, names):
        if n is not None:
            by_name.setdefault(n, i)
    wanted = (by_name.get(c) if p is None and c is not None else p for p, c in zip(parents, containers))
    return [w if w in there else None for w in wanted]


def _traverse(ids: list, parents: list, names: list, wanted: set[str]) -> dict[str, list]:
    """Depth-first over one co-located group. White: not met; grey: on the current walk; black: finished."""
    n = len(ids)
    at = {v: i for i, v in enumerate(ids)}
    up = [at[p] if p is not None else -1 for p in parents]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        if up[i] >= 0:
            children[up[i]].append(i)
    root, depth, enter, leave = [-1] * n, [-1] * n, [-1] * n, [-1] * n
    path: list = [None] * n
    chain: list = [None] * n
    status, cycle = ["below_loop"] * n, [None] * n
    with_names, with_ids = "names" in wanted, "path_ids" in wanted
    for r in range(n):
        if up[r] >= 0:
            continue
        clock = 0
        stack = [r]
        while stack:
            i = stack.pop()
            if i < 0:  # all below ~i is finished
                leave[~i] = clock - 1
                continue
            u = up[i]
            root[i], depth[i], status[i], enter[i] = r, depth[u] + 1 if u >= 0 else 0, "node" if u >= 0 else "root", clock
            if with_names:
                path[i] = [*(path[u] if u >= 0 else ()), names[i] or ""]
            if with_ids:
                chain[i] = [ids[i], *(chain[u] if u >= 0 else ())]
            clock += 1
            stack.append(~i)
            stack.extend(reversed(children[i]))
    colour = bytearray(n)  # 0 white, 1 grey, 2 black: follows links upwards among what no root reaches
    for i in range(n):
        if root[i] >= 0 or colour[i]:
            continue
        walk, j = [], i
        while not colour[j]:
            colour[j] = 1
            walk.append(j)
            j = up[j]
        if colour[j] == 1:  # a back edge closes a loop
            loop = walk[walk.index(j):]
            members = sorted(ids[x] for x in loop)
            for x in loop:
                status[x], cycle[x] = "loop", members
        for x in walk:
            colour[x] = 2
    return {"root_id": [ids[r] if r >= 0 else -1 for r in root], "depth": depth, "names": path, "n_descendants": [b - a for a, b in zip(enter, leave)], "enter": enter, "leave": leave, "status": status, "cycle": cycle, "path_ids": chain}


_TYPES = {"depth": pa.int32(), "names": pa.list_(pa.string()), "status": pa.string(), "cycle": pa.list_(pa.int64()), "path_ids": pa.list_(pa.int64())}


def hierarchy(nodes: DataFrame, scope: list[str], id_: str, parent: str, name: str, container: str, max_rows: int = MAX_ROWS, columns: list[str] | None = None) -> DataFrame:
    """Per (scope, id): parent_id, root_id, depth, names (root first), n_descendants, enter, leave, status, cycle, path_ids.

    status: root, node, loop (on a cycle; `cycle` lists its ids) or below_loop; of the last two, root_id and depth are -1
    and names is null. Rows that share (scope, root_id) are a tree; the descendants of a row are those of its tree whose
    enter lies within (enter, leave]; the root's enter is 0. path_ids are the ids from the row up to its root; descendants()
    turns them round. Components above max_rows give the same. Each row of a loop lists all of it, so the size of the result
    is the square of the loop's. Links: resolve_links(). `columns` restricts the result, and what is not asked for is not
    built. No rows give no rows; columns other than those named are ignored.
    """
    names_of = [c.split()[0] for c in RESULT.split(", ")]
    kept = [c for c in names_of if columns is None or c in columns]
    ddl = ", ".join(c for c in RESULT.split(", ") if c.split()[0] in kept)
    base = nodes.where(F.col(id_).isNotNull()).select(*scope, F.col(id_).cast("long").alias("_id"), F.col(parent).cast("long").alias("_p"), F.col(container).alias("_c"), F.col(name).alias("_name"))
    large = base.groupBy(*scope).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows).drop("_n")
    keys, jumped, small, found = [*scope, "_comp"], None, base, None
    if large.limit(1).count():
        links = pinned(resolve_links(_beside(base, large, scope, "true", "left_semi"), scope, "_id", "_p", "_name", "_c"))
        comp = pinned(pointer_jump(links, scope))
        over = comp.groupBy(*scope, "_label").agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows).select(*scope, F.col("_label").alias("_big"))
        found = _beside(comp, over, scope, "_label = _big", "left_anti").select(*scope, "_id", F.col("_parent").alias("_p"), F.lit(None).cast("string").alias("_c"), "_name", F.col("_label").alias("_comp"))
        small = _beside(base, large, scope, "true", "left_anti")
        jumped = _from_pointers(_beside(comp, over, scope, "_label = _big", "left_semi"), scope).select(*scope, "id", *kept)
    # rows of a scope meet by one shuffle; repeated ids fold where they lie
    folded = small.repartition(*scope).groupBy(*scope, "_id").agg(F.max(F.struct("_p", "_c", "_name")).alias("v"))
    located = folded.select(*scope, "_id", "v._p", "v._c", "v._name", F.lit(None).cast("long").alias("_comp")).sortWithinPartitions(*scope, "_id")
    kinds = {f.name: f.dataType.simpleString() for f in located.schema.fields}

    def traverse(table: pa.Table) -> Iterator[pa.RecordBatch]:
        flags = changed(table, keys)
        cuts = [0, *([i + 1 for i, x in enumerate(flags.to_pylist()) if x] if table.num_rows > 1 else []), table.num_rows]
        ids, parents, names, containers = (table.column(c).to_pylist() for c in ("_id", "_p", "_name", "_c"))
        parts: dict[str, list] = {c: [] for c in kept}
        for a, b in zip(cuts, cuts[1:]):
            up = _resolved(ids[a:b], parents[a:b], names[a:b], containers[a:b])
            got = {"parent_id": up, **_traverse(ids[a:b], up, names[a:b], set(kept))}
            for c in kept:
                parts[c].extend(got[c])
        arrays = [*(table.column(k) for k in scope), table.column("_id"), *(pa.array(parts[c], _TYPES.get(c, pa.int64())) for c in kept)]
        yield from pa.Table.from_arrays(arrays, names=[*scope, "id", *kept]).to_batches(max_chunksize=10_000)

    schema = f"{', '.join(f'`{k}` {kinds[k]}' for k in scope)}, id long, {ddl}"
    out = located.mapInArrow(whole_groups(keys, traverse), schema)
    if found is not None:
        out = out.unionByName(found.repartition(*keys).sortWithinPartitions(*keys, "_id").mapInArrow(whole_groups(keys, traverse), schema)).unionByName(jumped)
    return out


def _from_pointers(comp: DataFrame, scope: list[str]) -> DataFrame:
    """The rows of hierarchy() for components above the bound. A component holds either one root or one loop."""
    trees = pinned(pointer_jump(comp.where("not _loop").select(*scope, "_id", "_name", "_parent"), scope, True))
    on_path = trees.select(*scope, "_id", F.explode("_anc").alias("_cid"))
    sizes = on_path.groupBy(*scope, F.col("_cid").alias("_sid")).agg(F.count("*").alias("_n"))
    sized = pinned(_beside(trees.select(*scope, "_id", "_parent"), sizes, scope, "_id = _sid").select(*scope, "_id", "_parent", "_n"))
    # a row is entered after its parent and all below the siblings with lesser ids
    elder = Window.partitionBy(*scope, "_parent").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    steps = sized.where("_parent is not null").select(*scope, F.col("_id").alias("_kid"), (1 + F.coalesce(F.sum("_n").over(elder), F.lit(0))).alias("_step"))
    entered = _beside(on_path, steps, scope, "_cid = _kid").groupBy(*scope, F.col("_id").alias("_eid")).agg(F.sum("_step").alias("_enter"))
    ordered = _beside(sized, entered, scope, "_id = _eid", "left").select(*scope, F.col("_id").alias("_oid"), (F.col("_n") - 1).alias("_n"), F.coalesce("_enter", F.lit(0)).alias("_enter"))
    tree = _beside(trees, ordered, scope, "_id = _oid").selectExpr(
        *(f"`{k}`" for k in scope), "_id as id", "_parent as parent_id", "_root as root_id", "cast(_depth as int) as depth", "reverse(_names) as names", "_n as n_descendants",
        "_enter as enter", "_enter + _n as leave", "if(_parent is null, 'root', 'node') as status", "cast(null as array<long>) as cycle", "_anc as path_ids",
    )
    loops = comp.where("_loop")
    # after as many steps as there are rows every pointer is on the loop, and each row of the loop is pointed at
    ring = loops.select(*scope, "_label", F.col("_ptr").alias("_cid")).distinct()
    members = ring.groupBy(*scope, F.col("_label").alias("_mlabel")).agg(F.sort_array(F.collect_list("_cid")).alias("_members"))
    ringed = _beside(ring, members, scope, "_label = _mlabel").select(*scope, "_cid", "_members")
    looped = _beside(loops, ringed, scope, "_id = _cid", "left").selectExpr(
        *(f"`{k}`" for k in scope), "_id as id", "_parent as parent_id", "-1L as root_id", "-1 as depth", "cast(null as array<string>) as names", "0L as n_descendants",
        "-1L as enter", "-1L as leave", "if(_cid is not null, 'loop', 'below_loop') as status", "_members as cycle", "cast(null as array<long>) as path_ids",
    )
    return tree.unionByName(looped)


def descendants(tree: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, id, descendant, steps) from the result of hierarchy(): one row per row and each row below it.

    Each row names its ancestors, so the work is the size of the result.
    """
    node = tree.where("status = 'node'")
    return node.select(*scope, F.col("id").alias("descendant"), F.expr("posexplode(slice(path_ids, 2, size(path_ids))) as (k, id)")).selectExpr(*(f"`{k}`" for k in scope), "id", "descendant", "k + 1 as steps")
