"""Problem 2: schemas that drift from file to file.

Every file's schema is a tree of its JSON members. Two consecutive files of a station are
compared by a top-down tree edit distance: members of equal name match (a change of
type costs 1), a rename costs 1 to 1.5 by how far the names differ plus the distance of
the subtrees, an added or deleted node costs 1 each, and a subtree that goes in one place
and comes unchanged in another is a move that costs 1. Renames are assigned under each
parent at least total cost. The script lists an operation per path.

Renames and moves of all scripts are compiled into one projection: paths that replaced
each other and never stand in one file are one column, named by its most frequent
spelling; members of a renamed or moved object follow it. A member can move between
objects of one array element (or of the root), not out of an array. The projection is
applied to every row's JSON, which is then read with one schema. Its size is that of the
schema: above ``MAX_PATHS`` distinct paths or renames an error is raised, since data keys
written as member names are no schema (``DATA_MEMBERS`` names those that are known).

A change of the report follows the literal rule: a rename counts if under one parent
exactly one path goes and one comes with the same type; all else that goes is removed and
all that comes is added.

Cases. Rows whose JSON is null, cut or no object bring no paths, and a file with only such
rows has none; members that are null are not there; null stations and sequence numbers
are left out; repeated rows change nothing; gaps in the numbering are stepped over.
"""

from __future__ import annotations

import json
from collections import defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators.nested import parsed_object
from ledgermill.session import stage, tune

#: Members whose own members are data and not schema, with the names that a list form of them uses.
DATA_MEMBERS = {"candidate_scores": ("reading", "score")}
#: Distinct paths, and distinct renames and moves, that a projection may have (some 20 MB on the driver).
MAX_PATHS = 100_000
OPS = "op string, old_path string, new_path string, old_type string, new_type string, cost double, same_parent boolean, sole boolean"


def kind(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"


def walk(node: dict, prefix: str, out: dict) -> None:
    for name, value in node.items():
        if value is None:
            continue
        path = prefix + name
        what = kind(value)
        out[path].add(what)
        if what == "object" and name not in DATA_MEMBERS:
            walk(value, path + ".", out)
        elif what == "array":
            for x in value:
                if isinstance(x, dict):
                    walk(x, path + "[].", out)


def _paths(batches):
    for batch in batches:
        files = defaultdict(lambda: defaultdict(set))
        for station, seq, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            found = files[station, seq]
            found[""].add("")  # the file itself
            value = parsed_object(text)
            if value:
                walk(value, "", found)
        rows = [(s, n, p, t) for (s, n), paths in files.items() for p, types in paths.items() for t in types]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["station_id", "batch_seq", "path", "type"])


class _Node:
    __slots__ = ("children", "name", "path", "type")

    def __init__(self, name: str, path: str, what: str):
        self.name, self.path, self.type, self.children = name, path, what, {}

    def below(self):
        for c in self.children.values():
            yield c
            yield from c.below()

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())

    def shape(self):
        return self.name, self.type, tuple(sorted(c.shape() for c in self.children.values()))


def tree(paths: list) -> _Node:
    """The tree of (path, type) pairs; a child is known by its brackets and its name."""
    root, held = _Node("", "", "object"), {}
    for path, what in sorted(paths):
        if path in held:  # several types in one file
            held[path].type += "|" + what
            continue
        head, dot, name = path.rpartition(".")
        many = head.endswith("[]")
        parent = held.get(head[:-2] if many else head, root) if dot else root
        held[path] = parent.children[many, name] = _Node(name, path, what)
    return root


def assign(cost: list[list[float]]) -> list[int]:
    """For each row its column, at least total cost (rows <= columns)."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def distance(a: _Node, b: _Node, same: bool = True) -> tuple[float, list[tuple]]:
    """Least cost and script from the children of a to those of b; ``same``: equal parent paths."""
    cost, ops = 0.0, []
    for many in (False, True):
        left = {n: c for (m, n), c in a.children.items() if m == many}
        right = {n: c for (m, n), c in b.children.items() if m == many}
        for name in left.keys() & right.keys():
            x, y = left[name], right[name]
            inner, below = distance(x, y, same)
            step = float(x.type != y.type)
            cost += inner + step
            if step or not same:
                ops.append(("retype" if step else "follow", x, y, step, same, False))
            ops += below
        gone, come = [left[n] for n in sorted(left.keys() - right.keys())], [right[n] for n in sorted(right.keys() - left.keys())]
        sole = len(gone) == 1 and len(come) == 1
        table, inside = [], {}
        for i, x in enumerate(gone):
            row = []
            for j, y in enumerate(come):
                both = x.size() + y.size()
                if x.type != y.type:
                    row.append(0.0)
                    continue
                inside[i, j] = inner, below = distance(x, y, False)
                row.append(min(0.0, 1.5 - 0.5 * SequenceMatcher(None, x.name, y.name, autojunk=False).ratio() + inner - both))
            table.append(row + [0.0] * len(gone))  # a column of its own for each that stays unmatched
        chosen = assign(table)
        taken = set()
        for i, j in enumerate(chosen):
            if j < len(come) and (i, j) in inside and table[i][j] < 0:
                x, y = gone[i], come[j]
                inner, below = inside[i, j]
                step = table[i][j] + x.size() + y.size() - inner
                cost += step + inner
                ops.append(("rename", x, y, step, same, sole))
                ops += below
                taken.add(j)
            else:
                cost += gone[i].size()
                ops.append(("delete", gone[i], None, float(gone[i].size()), same, False))
        for j, y in enumerate(come):
            if j not in taken:
                cost += y.size()
                ops.append(("add", None, y, float(y.size()), same, False))
    return cost, ops


def script(old: list, new: list) -> list[tuple]:
    """The operations from one file's paths to the next one's, one row per path."""
    _, ops = distance(tree(old), tree(new))
    lost = {i: x for i, (op, x, *_) in enumerate(ops) if op == "delete"}
    moved, origins = {}, defaultdict(list)
    for i, x in lost.items():
        origins[x.shape()].append(i)
    for k, (op, _, y, *_) in enumerate(ops):
        if op == "add" and origins.get(y.shape()):
            moved[k] = origins[y.shape()].pop()
    gone = set(moved.values())
    rows = []
    for k, (op, x, y, cost, same, sole) in enumerate(ops):
        if k in gone:
            continue
        if k in moved:
            x = lost[moved[k]]
            rows.append(("move", x.path, y.path, x.type, y.type, 1.0, False, False))
            rows += [("follow", c.path, d.path, c.type, d.type, 0.0, False, False) for c, d in zip(sorted(x.below(), key=lambda n: n.path), sorted(y.below(), key=lambda n: n.path))]
        elif op in ("delete", "add"):
            top = x or y
            for node in (top, *top.below()):
                rows.append((op, node.path if op == "delete" else "", node.path if op == "add" else "", node.type if op == "delete" else "", node.type if op == "add" else "", 1.0, same, False))
        else:
            rows.append((op, x.path, y.path, x.type, y.type, cost, same, sole))
    return rows


def _scripts(batches):
    for batch in batches:
        rows = []
        for station, seq, before, old, new in zip(*(batch.column(i).to_pylist() for i in range(5))):
            pairs = lambda side: [(x["path"], x["type"]) for x in side if x["path"]]
            rows += [(station, seq, before, *r) for r in script(pairs(old), pairs(new))]
        columns = list(zip(*rows)) or [[]] * 11
        kinds = [pa.string(), pa.int32(), pa.int32()] + [pa.string()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
        names = ["station_id", "batch_seq", "previous_seq"] + [c.split()[0] for c in OPS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class Drift:
    """Schemas of all files, the scripts between them and the compiled projection."""

    def __init__(self, jobs: DataFrame):
        tune(jobs.sparkSession)
        self.jobs = jobs
        rows = jobs.select(F.col("station_id").cast("string").alias("station_id"), F.col("batch_seq").cast("int").alias("batch_seq"), F.col("result_json").cast("string").alias("result_json")).where("station_id is not null and batch_seq is not null")
        #: station_id, batch_seq, path, type: each file's paths, and one row with path '' for the file.
        self.paths = stage(rows.mapInArrow(_paths, "station_id string, batch_seq int, path string, type string").distinct(), "drift-paths")
        self._scripts = None

    def scripts(self) -> DataFrame:
        """Operations from each file's predecessor to the file."""
        if self._scripts is None:
            trees = stage(
                self.paths.groupBy("station_id", "batch_seq").agg(F.sort_array(F.collect_list(F.struct("path", "type"))).alias("tree")).withColumn("same", F.xxhash64("tree")), "drift-trees"
            )
            order = Window.partitionBy("station_id").orderBy("batch_seq")  # two numbers a file
            steps = trees.select("station_id", "batch_seq", "same").withColumn("previous_seq", F.lag("batch_seq").over(order)).withColumn("before", F.lag("same").over(order))
            changed = steps.where("previous_seq is not null and same <> before").select("station_id", "batch_seq", "previous_seq")
            new, old = trees.select("station_id", "batch_seq", F.col("tree").alias("new")), trees.select("station_id", F.col("batch_seq").alias("previous_seq"), F.col("tree").alias("old"))
            # Trees compress well on disk and not in memory, so their joins sort and merge instead of broadcasting.
            pairs = changed.join(new.hint("merge"), ["station_id", "batch_seq"]).join(old.hint("merge"), ["station_id", "previous_seq"]).select("station_id", "batch_seq", "previous_seq", "old", "new")
            self._scripts = stage(pairs.mapInArrow(_scripts, "station_id string, batch_seq int, previous_seq int, " + OPS), "drift-scripts")
        return self._scripts

    def changes(self) -> DataFrame:
        """(station_id, batch_seq, old_path, new_path, change_kind) by the literal rule."""
        s = self.scripts()
        kept = (F.col("same_parent") & (F.col("op") == "retype")) | (F.col("same_parent") & F.col("sole") & (F.col("op") == "rename"))
        row = lambda old, new, what: F.struct(old.alias("old_path"), new.alias("new_path"), F.lit(what).alias("change_kind"))
        none, old, new = F.lit(""), F.col("old_path"), F.col("new_path")
        out = F.when(kept & (F.col("op") == "retype"), F.array(row(old, new, "retyped"))).when(kept, F.array(row(old, new, "renamed")))
        out = out.otherwise(F.filter(F.array(row(old, none, "removed"), row(none, new, "added")), lambda r: (r["old_path"] != "") | (r["new_path"] != "")))
        return s.select("station_id", "batch_seq", F.inline(out))

    def projection(self) -> dict[str, tuple[str, str]]:
        """Path -> (canonical path, type). Distinct paths reach the driver, never rows or files."""
        known = bounded(self.paths.where("path <> ''").groupBy("path", "type").agg(F.count("*").alias("n")), "paths")
        uses, types = defaultdict(int), defaultdict(set)
        for r in known:
            uses[r["path"]] += r["n"]
            types[r["path"]].add(r["type"])
        renames = bounded(self.scripts().where("op in ('rename', 'move')").groupBy("old_path", "new_path").agg(F.count("*").alias("n")), "renames")
        names = sorted({r["old_path"] for r in renames} | {r["new_path"] for r in renames})
        together = set()
        if names:
            some = self.paths.sparkSession.createDataFrame([(n,) for n in names], "path string")
            own = self.paths.select("station_id", "batch_seq", "path").distinct().join(F.broadcast(some), "path")  # at most 2 * MAX_PATHS names
            both = own.alias("a").join(own.alias("b"), F.expr("a.station_id = b.station_id and a.batch_seq = b.batch_seq and a.path < b.path"))
            together = {(r[0], r[1]) for r in bounded(both.select("a.path", "b.path").distinct(), "pairs of renamed paths")}
        group = {n: {n} for n in names}
        whole: dict[str, str] = {}

        def canonical(path: str, seen: frozenset = frozenset()) -> str:
            if path not in whole:
                name = path if path in seen else max(group.get(path, {path}), key=lambda p: (uses[p], p))
                head, dot, last = name.rpartition(".")
                above = head.removesuffix("[]")
                whole[path] = (canonical(above, seen | {path}) if above else "") + head[len(above) :] + dot + last
            return whole[path]

        holds = lambda path: not path or types[path] <= {"object"}
        frame = lambda path: path[: path.rfind("[].") + 1].removesuffix("[")
        inside = lambda path: path.rpartition(".")[0].removesuffix("[]")
        for depth in sorted({n.count("[]") for n in names}):
            for r in sorted((r for r in renames if r["new_path"].count("[]") == depth), key=lambda r: (-r["n"], r["old_path"], r["new_path"])):
                old, new = r["old_path"], r["new_path"]
                a, b = group[old], group[new]
                if old.count("[]") != depth or a is b or any((min(x, y), max(x, y)) in together for x in a for y in b):
                    continue
                whole.clear()
                moved = inside(old) != inside(new)
                if (canonical(frame(old)) if frame(old) else "") != (canonical(frame(new)) if frame(new) else "") or (moved and not all(holds(inside(p)) or p.rpartition(".")[0].endswith("[]") for p in (old, new))):
                    continue
                if new.startswith(old + ".") or old.startswith(new + "."):  # into or out of itself
                    continue
                a |= b
                for x in b:
                    group[x] = a
        whole.clear()
        kinds = defaultdict(set)
        for path in uses:
            kinds[canonical(path)] |= types[path]
        out = {}
        for path in uses:
            name = canonical(path)
            seen = set(kinds[name])
            out[path] = name, seen.pop() if len(seen) == 1 else "object" if "object" in seen and seen <= {"object", "array"} and name.rpartition(".")[2] in DATA_MEMBERS else "string"
        return out

    def table(self) -> DataFrame:
        """The rows of ``every_row`` that have a result."""
        return self.every_row().where("no_result is null").drop("no_result")

    def every_row(self) -> DataFrame:
        """All jobs with one consistent ``result``, projected and typed.

        A row whose JSON is no whole object keeps its job columns, with a null ``result`` and
        the reason in ``no_result``: null, empty, cut or no object.
        """
        plan = self.projection()
        schema = compiled_schema(plan)
        keep = ["id", "station_id", "batch_seq", "batch_file", "status", "updated_at"]
        rows = self.jobs.select(*keep, F.col("result_json").cast("string").alias("result_json"), F.lit(None).cast("string").alias("no_result"))
        return rows.mapInArrow(_project(plan), rows.schema).select(*keep, F.from_json("result_json", schema).alias("result"), "no_result")


def bounded(rows: DataFrame, what: str) -> list:
    """Rows of a summary that must fit on the driver."""
    got = rows.limit(MAX_PATHS + 1).collect()
    if len(got) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} {what}: are data keys written as member names?")
    return got


def compiled_schema(plan: dict[str, tuple[str, str]]) -> str:
    """The DDL of the table that the projection gives."""
    root, held = _Node("", "", "object"), {}
    for path, what in sorted(set(plan.values())):
        head, dot, name = path.rpartition(".")
        parent = held.get(head.removesuffix("[]"), root) if dot else root
        held[path] = parent.children[head.endswith("[]"), name] = _Node(name, path, what)

    def ddl(node: _Node) -> str:
        if node.name in DATA_MEMBERS:
            return "map<string,double>"
        fields = ",".join(f"`{c.name}`:{ddl(c)}" for c in node.children.values() if node.type in ("object", "array"))
        if node.type == "object":
            return f"struct<{fields}>" if fields else "map<string,string>"
        if node.type == "array":
            return f"array<struct<{fields}>>" if fields else "array<string>"
        return {"number": "double", "boolean": "boolean"}.get(node.type, "string")

    return ", ".join(f"`{c.name}` {ddl(c)}" for c in root.children.values()) or "_none string"


def no_result(text: str | None) -> str:
    """Why a text that is no whole JSON object gives no result."""
    if text is None:
        return "null"
    if not text.strip():
        return "empty"
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return "cut"
    return "no object"


def _project(plan: dict[str, tuple[str, str]]):
    def scalar(value):
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def fill(node: dict, prefix: str, out: dict, base: str) -> dict:
        """Put a node's members where they belong in ``out``, the object at canonical path ``base``."""
        for name, value in node.items():
            hit = plan.get(prefix + name)
            if value is None or hit is None:
                continue
            path, what = hit
            *above, last = path[len(base) :].split(".")
            into = out
            for step in above:
                into = into.setdefault(step, {})
                if not isinstance(into, dict):
                    break
            if not isinstance(into, dict):
                continue
            if last in DATA_MEMBERS:
                key, number = DATA_MEMBERS[last]
                if isinstance(value, list):
                    into[last] = {str(x.get(key)): x.get(number) for x in value if isinstance(x, dict)}
                elif isinstance(value, dict):
                    into[last] = value
            elif what == "object" and isinstance(value, dict):
                into.setdefault(last, {})
                fill(value, prefix + name + ".", out, base)
            elif what == "array" and isinstance(value, list):
                into[last] = [fill(x, prefix + name + "[].", {}, path + "[].") if isinstance(x, dict) else scalar(x) for x in value if x is not None]
            else:
                into[last] = value if what in ("number", "boolean") else scalar(value)
        return out

    def run(batches):
        for batch in batches:
            at, why = batch.schema.get_field_index("result_json"), batch.schema.get_field_index("no_result")
            texts = batch.column(at).to_pylist()
            objects = [parsed_object(t) for t in texts]
            batch = batch.set_column(at, "result_json", pa.array([None if o is None else json.dumps(fill(o, "", {}, ""), ensure_ascii=False) for o in objects], pa.string()))
            yield batch.set_column(why, "no_result", pa.array([None if o is not None else no_result(t) for o, t in zip(objects, texts)], pa.string()))

    return run
