"""Schemas of JSON documents that drift between files: inventory, edit scripts, and one consistent table.

Every key at any depth is a field, named by its path (``a.b`` in an object, ``a[].b`` in the objects of a list). ``inventory``
counts the fields and their JSON types per file where the rows are. The schemas of neighbouring files are then compared as
trees: nodes with one path are kept; a removed and an added node may be mapped onto each other only where the documents
prove it (for every id in both files the values agree, and not all are null); everything else is a deletion or an addition.
``edit_script`` finds the mapping of least cost top-down, assigning the children of mapped nodes to each other by the
Hungarian method and, for proven pairs under parents that are not mapped, as moves. ``unify`` compiles the scripts into a
projection for each file, so all files read as one table.

The proof is a signature per field over the ids in both files: the exclusive or of two independent 64-bit hashes of (id,
value) and the number of values. It is combined before the shuffle, needs no pairs of fields and no document twice at one
place. Only schemas and signatures come to the driver; a schema of more than ``MOST_FIELDS`` fields or ``MOST_CHARS`` characters
of names (as where keys are data) is an error there, not a cut.

Defined cases. Texts that are null or no JSON object are left aside, also as holders of an id; rows whose table, file number
or (for the proof) id is null take no part in it. Documents of any depth are read. Whole rows that repeat count once. Objects
are equal without regard to key order and null members, numbers by value (1 equals 1.0), lists entry by entry. Of repeated
keys the last holds. In names, a backslash goes before each dot, bracket and backslash that is part of a key, and ``\\e`` stands
for the empty key. A file whose documents are all left aside has no fields. An empty table has no changes. Ties between equal
signatures go to the pair of least tree cost, then to the more alike name, then to the alphabet.
"""

from __future__ import annotations

import difflib
import hashlib
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.jsontext import by_bytes, canonical_text, clean, dump, load_object
from stratafold.session import materialize

TYPE_BITS = {str: 1, int: 2, float: 2, bool: 4, dict: 8, list: 16, type(None): 0}
#: Entries and characters that a task holds before it passes its counts on; bytes of text it holds at once.
FLUSH_ROWS, FLUSH_CHARS, TEXT_BYTES = 50_000, 8 << 20, 4 << 20
#: Largest schemas, of all files together, that come to the driver.
MOST_FIELDS, MOST_CHARS = 200_000, 64 << 20

_ODD = re.compile(r"[\\.\[\]]")


def escape(key: str) -> str:
    """A key as a part of a field's name."""
    return _ODD.sub(r"\\\g<0>", key) if _ODD.search(key) else key or "\\e"


def parts_of(path: str) -> list[str]:
    """The escaped keys of a name, each with the brackets of the lists below it."""
    return re.findall(r"(?:\\.|[^.\\])+", path, re.DOTALL) if "\\" in path else path.split(".")


def steps_of(path: str) -> list[tuple[str, int]]:
    """Keys from the top, each with the number of list levels below it."""
    steps = []
    for part in parts_of(path):
        name = part
        while name.endswith("[]"):
            name = name[:-2]
        lists = (len(part) - len(name)) // 2
        steps.append((re.sub(r"\\(.)", lambda m: "" if m[1] == "e" else m[1], name, flags=re.DOTALL) if "\\" in name else name, lists))
    return steps


def parent_of(path: str) -> str:
    head = ".".join(parts_of(path)[:-1])
    while head.endswith("[]"):
        head = head[:-2]
    return head


def walk(record: dict) -> Iterator[tuple[str, int]]:
    """Name and type bits of every field of a record of any depth, once for each occurrence."""
    todo: list[tuple[dict | list, str]] = [(record, "")]
    while todo:
        node, path = todo.pop()
        if isinstance(node, dict):
            for key, child in node.items():
                at = f"{path}.{escape(key)}" if path else escape(key)
                yield at, TYPE_BITS[type(child)]
                if isinstance(child, (dict, list)):
                    todo.append((child, at))
        else:
            at = path + "[]"
            todo += [(child, at) for child in node if isinstance(child, (dict, list))]


def inventory(df: DataFrame, table: str, file_no: str, body: str) -> DataFrame:
    """``table_name, file_no, field, types`` for every field of every file; the empty field stands for the file itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
        held = chars = 0

        def rows() -> pa.RecordBatch:
            flat = [(t, n, clean(f), m) for (t, n), fields in found.items() for f, m in fields.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.int32()))], names=["table_name", "file_no", "field", "types"])

        for batch in batches:
            for part in by_bytes(batch, 2, TEXT_BYTES):
                for t, n, text in zip(*(c.to_pylist() for c in part.columns)):
                    fields = found[t, n]
                    fields.setdefault("", 0)
                    record = load_object(text)
                    for at, bits in walk(record) if record is not None else ():
                        old = fields.get(at)
                        fields[at] = bits | (old or 0)
                        if old is None:
                            held, chars = held + 1, chars + len(at)
                            if held > FLUSH_ROWS or chars > FLUSH_CHARS:
                                yield rows()
                                found.clear()
                                held = chars = 0
                                fields = found[t, n]
        if found:
            yield rows()

    source = df.select(F.col(table).cast("string").alias("table_name"), F.col(file_no).cast("long").alias("file_no"), F.col(body)).where("table_name IS NOT NULL AND file_no IS NOT NULL")
    return source.mapInArrow(run, "table_name string, file_no long, field string, types int").groupBy("table_name", "file_no", "field").agg(F.bit_or("types").alias("types"))


def field_value(record: object, steps: Sequence[tuple[str, int]], leaf: Callable[[object], object]) -> object:
    """``leaf`` of the value of a field, None where it is absent or null; below lists a list with that of every entry at its place,
    None where there is no list."""
    node = record
    for k, (name, lists) in enumerate(steps):
        node = node.get(name) if isinstance(node, dict) else None
        if node is None:
            return None
        if lists:
            rest = steps[k + 1 :]
            return spread_value(node, lists, lambda entry: field_value(entry, rest, leaf))
    return leaf(node)


def spread_value(node: object, lists: int, leaf: Callable[[object], object]) -> list | None:
    """``leaf`` of every entry of a list that is nested ``lists`` deep."""
    if not isinstance(node, list):
        return None
    return [leaf(x) if lists == 1 else spread_value(x, lists - 1, leaf) for x in node]


def held_value(value: object, lists: int) -> object:
    """A field's value with None for each list, of those on its path, of which all entries are None."""
    if not lists or value is None:
        return value
    values = [held_value(x, lists - 1) for x in value]
    return values if any(x is not None for x in values) else None


def signatures(df: DataFrame, table: str, file_no: str, key: str, body: str, wanted: Mapping[tuple[str, int], Sequence[tuple[int, int, Sequence[str]]]]) -> DataFrame:
    """``table_name, pair_no, side, field, sig_1, sig_2, present`` of the wanted fields, over the ids that both files of a pair hold.

    ``wanted`` gives for each (table, file) the pairs it is part of: the pair's number, its side in it and the fields.
    """
    plan = {at: [(pair, side, [(f, steps_of(f)) for f in fields]) for pair, side, fields in parts] for at, parts in wanted.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, n, i, text in (row for part in by_bytes(batch, 3, TEXT_BYTES) for row in zip(*(c.to_pylist() for c in part.columns))):
                parts = plan.get((t, n))
                record = load_object(text) if parts else None
                if record is None:
                    continue
                for pair, side, fields in parts:
                    out.append((t, pair, i, side, "", 0, 0))
                    for field, steps in fields:
                        value = held_value(field_value(record, steps, lambda node: node), sum(lists for _, lists in steps))
                        if value is not None:
                            digest = hashlib.blake2b(canonical_text([i, value]).encode(), digest_size=16).digest()
                            out.append((t, pair, i, side, field, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["table_name", "pair_no", "id", "side", "field", "h1", "h2"])

    source = df.select(F.col(table).cast("string").alias("table_name"), F.col(file_no).cast("long").alias("file_no"), F.col(key).cast("string").alias("id"), F.col(body))
    values = source.where("id IS NOT NULL").mapInArrow(run, "table_name string, pair_no long, id string, side int, field string, h1 long, h2 long")
    shared = (
        values.groupBy("table_name", "pair_no", "id")
        .agg(F.bit_or("side").alias("sides"), F.collect_set(F.when(F.col("field") != "", F.struct("side", "field", "h1", "h2"))).alias("found"))
        .where("sides = 3")
    )
    return (
        shared.select("table_name", "pair_no", F.explode("found").alias("f"))
        .groupBy("table_name", "pair_no", F.col("f.side").alias("side"), F.col("f.field").alias("field"))
        .agg(F.bit_xor("f.h1").alias("sig_1"), F.bit_xor("f.h2").alias("sig_2"), F.count(F.lit(1)).alias("present"))
    )


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in an assignment of least total cost (Hungarian method, rows <= columns)."""
    n, m = cost.shape
    u, v, row_of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while row_of[j]:
            used[j] = True
            reduced = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[nxt]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = [-1] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


@dataclass(frozen=True)
class Edit:
    """One step of a script: ``added``, ``removed``, ``type_changed``, ``renamed`` (same parent) or ``moved``."""

    change: str
    field: str
    new_field: str = ""


#: Costs of a step; a node that is kept costs nothing.
RENAME, MOVE, DROP, NEVER = 1.0, 1.25, 1.0, 1e6


def edit_script(old: Mapping[str, int], new: Mapping[str, int], proven: set[tuple[str, str]]) -> list[Edit]:
    """The least-cost script from schema ``old`` to ``new`` (path -> type bits); only ``proven`` pairs may be mapped."""
    gone, come = old.keys() - new.keys(), new.keys() - old.keys()
    proven = {(a, b) for a, b in proven if a in gone and b in come}
    below: dict[str, list[str]] = defaultdict(list)
    for side in (gone, come):
        for path in sorted(side):
            below[parent_of(path)].append(path)
    mapped: dict[str, str] = {}
    memo: dict[tuple[str, str], tuple[float, list[tuple[str, str]]]] = {}

    weights: dict[str, float] = {}
    for path in sorted(gone | come, key=lambda p: len(parts_of(p)), reverse=True):
        weights[path] = DROP + sum(weights[c] for c in below[path])
    weight = weights.__getitem__

    def unlike(a: str, b: str) -> float:
        return 1e-3 * (1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())

    def match(left: list[str], right: list[str]) -> tuple[float, list[tuple[str, str]]]:
        """Least cost of turning the children ``left`` into ``right``, and the pairs it maps."""
        if not left or not right:
            return sum(map(weight, left)) + sum(map(weight, right)), []
        n, m = len(left), len(right)
        cost = np.zeros((n, m + n))
        pairs: dict[tuple[int, int], list[tuple[str, str]]] = {}
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                value, pairs[i, j] = node(a, b)
                cost[i, j] = value - weight(b)
            cost[i, m:] = weight(a)
        to = assignment(cost)
        got = [p for i, j in enumerate(to) if j < m and cost[i, j] < NEVER / 2 for p in pairs[i, j]]
        return float(sum(cost[i, j] for i, j in enumerate(to))) + sum(map(weight, right)), got

    def node(a: str, b: str) -> tuple[float, list[tuple[str, str]]]:
        if (a, b) not in memo:
            if (a, b) in proven:
                rest, got = match(below[a], below[b])
                memo[a, b] = RENAME + unlike(a, b) + rest, [(a, b), *got]
            else:
                memo[a, b] = NEVER, []
        return memo[a, b]

    # Nodes nest as deep as the documents do; these calls take no part of the machine's own stack.
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 10 * max((len(parts_of(p)) for p in gone | come), default=0) + 2_000))
    for parent in sorted((old.keys() & new.keys()) | {""}):
        left, right = [p for p in below[parent] if p in gone], [p for p in below[parent] if p in come]
        mapped |= dict(match(left, right)[1])
    sys.setrecursionlimit(limit)
    moved: dict[str, str] = {}
    taken = set(mapped.values())
    left = sorted({a for a, b in proven if a not in mapped and b not in taken})
    right = sorted({b for a, b in proven if a not in mapped and b not in taken})
    if left and right:
        cost = np.full((len(left), len(right) + len(left)), 2 * DROP)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                cost[i, j] = MOVE + unlike(a, b) if (a, b) in proven else NEVER
        moved = {left[i]: right[j] for i, j in enumerate(assignment(cost)) if j < len(right) and cost[i, j] < NEVER / 2}
    edits = [Edit("renamed", a, b) for a, b in mapped.items()] + [Edit("moved", a, b) for a, b in moved.items()]
    ends = set(mapped) | set(moved), set(mapped.values()) | set(moved.values())
    edits += [Edit("removed", p) for p in gone - ends[0]] + [Edit("added", p) for p in come - ends[1]]
    edits += [Edit("type_changed", p) for p in old.keys() & new.keys() if old[p] != new[p]]
    return sorted(edits, key=lambda e: (e.change, e.field, e.new_field))


@dataclass(frozen=True)
class Drift:
    """The schemas of all files of a table, and the script that leads to each file from the one before."""

    schemas: dict[int, dict[str, int]]
    scripts: dict[int, list[Edit]]


def compare_files(df: DataFrame, table: str, file_no: str, key: str, body: str) -> dict[str, Drift]:
    """Schemas and scripts by table name; runs the inventory and, where fields went and came, the proof."""
    schemas: dict[str, dict[int, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    found = materialize(inventory(df, table, file_no, body))
    count, chars = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("field")), F.lit(0))).first()
    if count > MOST_FIELDS or chars > MOST_CHARS:
        raise ValueError(f"the schemas have {count} fields with {chars} characters of names: more than {MOST_FIELDS} or {MOST_CHARS}; are keys data?")
    for t, n, field, types in found.collect():
        fields = schemas[t][n]
        if field:
            fields[field] = types
    wanted: dict[tuple[str, int], list] = defaultdict(list)
    for t, files in schemas.items():
        numbers = sorted(files)
        for before, after in zip(numbers, numbers[1:]):
            gone, come = sorted(files[before].keys() - files[after].keys()), sorted(files[after].keys() - files[before].keys())
            if gone and come:
                wanted[t, before].append((after, 1, gone))
                wanted[t, after].append((after, 2, come))
    proofs: dict[tuple[str, int], dict[tuple, tuple[set, set]]] = defaultdict(lambda: defaultdict(lambda: (set(), set())))
    if wanted:
        for t, pair, side, field, *signature in signatures(df, table, file_no, key, body, wanted).collect():
            proofs[t, pair][tuple(signature)][side - 1].add(field)
    out = {}
    for t, files in schemas.items():
        numbers = sorted(files)
        scripts = {}
        for before, after in zip(numbers, numbers[1:]):
            proven = {(a, b) for olds, news in proofs[t, after].values() for a in olds for b in news}
            scripts[after] = edit_script(files[before], files[after], proven)
        out[t] = Drift({n: files[n] for n in numbers}, scripts)
    return out


def report(df: DataFrame, table: str, file_no: str, key: str, body: str) -> DataFrame:
    """``table_name, export_no, change, field, new_field``: every change of a field from one file to the next."""
    rows = [(t, n, "renamed" if e.change == "moved" else e.change, e.field, e.new_field) for t, drift in compare_files(df, table, file_no, key, body).items() for n, script in drift.scripts.items() for e in script]
    return df.sparkSession.createDataFrame(rows, "table_name string, export_no int, change string, field string, new_field string")


def lineage(drift: Drift) -> dict[str, dict[int, str]]:
    """For each field of the consistent table the path it has in each file that holds it.

    Fields go by their latest path; one that was removed keeps its last path, and comes back as the same field if that path
    is added again.
    """
    numbers = sorted(drift.schemas)
    fields: dict[str, dict[int, str]] = {}
    for n in numbers:
        renames = {e.field: e.new_field for e in drift.scripts.get(n, []) if e.new_field}
        for a in sorted(renames):
            history = fields.pop(a, {})
            fields[renames[a]] = history | fields.get(renames[a], {})
        for path in drift.schemas[n]:
            fields.setdefault(path, {})[n] = path
    return fields


KINDS = {1: "string", 2: "double", 4: "boolean"}
_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def as_text(value: object) -> str:
    return clean(value) if isinstance(value, str) else clean(dump(value, compact=True))


def as_double(value: object) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def as_boolean(value: object) -> bool | None:
    return value if isinstance(value, bool) else None


def no_objects(value: object) -> list | None:
    """The entries of a list as text, null for objects."""
    return spread_value(value, 1, lambda entry: None if entry is None or isinstance(entry, dict) else as_text(entry))


def whole(steps: Sequence[tuple[str, int]]) -> Callable[[object], object]:
    """The whole value of a field as text, below lists that of all entries as one JSON text."""

    def read(record: object) -> str | None:
        value = field_value(record, steps, lambda node: node)
        return None if value is None else as_text(value)

    return read


@dataclass(frozen=True)
class Target:
    """A column of the consistent table: its field and type, and how each file's records give it."""

    field: str
    kind: str
    lists: int
    read: dict[int, Callable[[object], object]]


def projection(drift: Drift) -> list[Target]:
    """The consistent table's columns: for each field how to read it at the path it has in each file.

    A field has its type if all files agree on one of string, number and boolean; otherwise it is read as text. Groups are
    left to their members. A field below lists is an array of its values, one for every entry of the list and null where an
    entry lacks it, so the arrays of a list's members agree in length and place. A list with members is itself an array of
    its entries that are no objects, as text, with null in the place of each object; a list without members, or of which
    some files hold another type, is read whole as JSON text. A field that is below lists in some files and below fewer in
    others is read as JSON text.
    """
    leaves = {"string": as_text, "double": as_double, "boolean": as_boolean}
    targets = []
    fields = lineage(drift)
    with_members = {f[: at.start()] for f in fields for at in re.finditer(r"\[\]", f)}
    for field, paths in sorted(fields.items()):
        bits = 0
        for n, path in paths.items():
            bits |= drift.schemas[n][path]
        if bits == 8:
            continue
        kind = KINDS.get(bits, "string")
        members = bits == 16 and field in with_members
        nested = {sum(lists for _, lists in steps_of(path)) for path in paths.values()}
        read = {}
        for n, path in paths.items():
            steps = steps_of(path)
            if len(nested) > 1:
                read[n] = whole(steps)
            else:
                read[n] = partial(field_value, steps=steps, leaf=no_objects if members else leaves[kind])
        targets.append(Target(field, kind, 0 if len(nested) > 1 else max(nested) + members, read))
    return targets


def unify(df: DataFrame, drift: Drift, file_no: str, body: str, keep: Sequence[str]) -> DataFrame:
    """All files as one table: the ``keep`` columns and the fields of ``projection``; rows without an object are left aside.

    The text is parsed once a row; the projection compiled for the row's file picks each field from the parsed value.
    """
    targets = projection(drift)
    taken = {k.lower() for k in keep}
    fields, arrow = [], []
    for target in targets:
        # Column names ignore case and take no dots, field names do and may: parts are joined by __, a clash is numbered.
        name = "__".join(name for name, _ in steps_of(target.field)) or "__"
        unique, k = name, 2
        while unique.lower() in taken:
            unique, k = f"{name}_{k}", k + 1
        taken.add(unique.lower())
        kind, like = target.kind, _ARROW[target.kind]
        for _ in range(target.lists):
            kind, like = f"array<{kind}>", pa.list_(like)
        fields.append((unique, kind))
        arrow.append(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_file: dict[int, list[tuple[int, Callable[[object], object]]]] = defaultdict(list)
        for at, target in enumerate(targets):
            for n, read in target.read.items():
                by_file[n].append((at, read))
        for batch in batches:
            for part in by_bytes(batch, 1, TEXT_BYTES):
                held, values = [], [[] for _ in targets]
                for row, (n, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    record = load_object(text)
                    if record is None:
                        continue
                    held.append(row)
                    for column in values:
                        column.append(None)
                    for at, read in by_file.get(n, ()):
                        values[at][-1] = read(record)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(held, pa.int64())) for c in part.columns[2:]), *(pa.array(v, t) for v, t in zip(values, arrow))], names=[*keep, *(f for f, _ in fields)])

    schema = T.StructType([*(T.StructField(k, df.schema[k].dataType) for k in keep), *(T.StructField(f, T._parse_datatype_string(kind)) for f, kind in fields)])
    return df.select(F.col(file_no).cast("long").alias("__file"), F.col(body).alias("__body"), *keep).mapInArrow(run, schema)
