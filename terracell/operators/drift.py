"""Schemas that drift between the files of a feed: every change, and one table of all files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions.checkpoint import cut
from terracell.functions.treediff import diff, tree

KINDS = ("string", "integer", "decimal", "boolean", "array", "object")
AGREE = 0.95
ELEMENT = "[]"  # the last step of the path to the elements of an array
HELD = 50_000  # entries that a task holds before it hands them over

_CHANGE = (
    "file_id bigint, feed_code string, edition int, old_id bigint, drift_kind string, old_path array<string>, new_path array<string>, "
    "old_kind string, new_kind string, cost double"
)
_BITS = {str: 1, int: 2, float: 4, bool: 8, list: 16, dict: 32}


def _unique(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("one key twice")
    return out


def _no_constant(word: str) -> None:
    raise ValueError(word)


_DECODE = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_no_constant).decode


def read_record(payload: str | None) -> dict[str, object] | None:
    """The object of a payload; None for null, for what is no JSON, no object or has one key twice."""
    try:
        got = _DECODE(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _shape(value: object) -> object:
    """The form of a value without its scalars: alike for records with the same fields and kinds."""
    if isinstance(value, dict):
        kinds = tuple(map(type, value.values()))
        if dict in kinds or list in kinds:
            return tuple(value), tuple([_shape(v) if isinstance(v, dict | list) else _BITS.get(type(v), 0) for v in value.values()])
        return tuple(value), kinds
    if isinstance(value, list):
        return frozenset(map(_shape, value))
    return _BITS.get(type(value), 0)


def _fields(shape: object, path: tuple[str, ...], out: dict[tuple[str, ...], int]) -> int:
    """The bit of the kind of a shape; the kinds of all that lies below it go to ``out``."""
    if not isinstance(shape, tuple | frozenset):
        return _BITS.get(shape, 0) if isinstance(shape, type) else shape
    inner = zip(*shape, strict=True) if isinstance(shape, tuple) else [(ELEMENT, s) for s in shape]
    for name, s in inner:
        at = (*path, name)
        out[at] = out.get(at, 0) | _fields(s, at, out)
    return _BITS[dict if isinstance(shape, tuple) else list]


def _reached(value: object, path: list[str]) -> Iterator[object]:
    """What lies at a path, once for each element of the arrays on it."""
    if not path:
        yield value
    elif path[0] == ELEMENT and isinstance(value, list):
        for v in value:
            yield from _reached(v, path[1:])
    elif isinstance(value, dict) and path[0] in value:
        yield from _reached(value[path[0]], path[1:])


def _digest(values: list[object]) -> int | None:
    """A number for the value as canonical JSON; None where there is nothing but nulls."""
    if all(v is None for v in values):
        return None
    text = json.dumps(values, sort_keys=True, ensure_ascii=True, separators=(",", ":"))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def profile(raw: DataFrame, key: str = "feature_code") -> DataFrame:
    """Every field of every file, nested ones too: ``file_id, path, kinds``, the kinds as bits in the order of KINDS.

    One pass over the payloads; a task hands over one row per file and path it has met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, tuple[str, ...]], int] = {}
        seen: set[tuple[int, object]] = set()

        def rows() -> pa.RecordBatch:
            columns = [pa.array([f for f, _ in held], pa.int64()), pa.array([list(p) for _, p in held], pa.list_(pa.string())), pa.array(list(held.values()), pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["file_id", "path", "kinds"])

        for batch in batches:
            for file_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = read_record(payload)
                if record:
                    record.pop(key, None)
                    shape = file_id, _shape(record)
                    if shape not in seen:  # the fields of a form are taken down once a file
                        seen.add(shape)
                        some: dict[tuple[str, ...], int] = {}
                        _fields(shape[1], (), some)
                        for path, bits in some.items():
                            held[file_id, path] = held.get((file_id, path), 0) | bits
            if len(held) > HELD or len(seen) > HELD:
                yield rows()
                held.clear()
                seen.clear()
        yield rows()

    each = raw.select(F.col("file_id").cast("long"), F.col("payload").cast("string")).where("file_id is not null")
    return each.mapInArrow(run, "file_id bigint, path array<string>, kinds int").groupBy("file_id", "path").agg(F.bit_or("kinds").alias("kinds"))


def _values(key: str):
    """Digests of the wanted fields: a task hands over the least and the greatest of each pair, side, field and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, int]] = {}

        def rows() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
            low, high = zip(*held.values(), strict=True) if held else ([], [])
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                ["file_id", "old_id", "is_new", "number", "feature", "lo", "hi"],
            )

        for batch in batches:
            for payload, wanted in zip(batch.column("payload").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                record = read_record(payload)
                feature = record.get(key) if record else None
                if feature is None:
                    continue
                feature = feature if isinstance(feature, str) else json.dumps(feature)
                for w in wanted:
                    v = _digest(list(_reached(record, w["path"])))
                    if v is not None:
                        at = w["file_id"], w["old_id"], w["is_new"], w["number"], feature
                        lo, hi = held.get(at, (v, v))
                        held[at] = min(lo, v), max(hi, v)
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    return run


def _scripts(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def named(bits: int) -> str:
        return "|".join(k for i, k in enumerate(KINDS) if bits >> i & 1) or "null"

    for batch in pairs:
        out = []
        for r in batch.itertuples(index=False):
            sides = [[(tuple(f["path"]), named(f["kinds"])) for f in some] for some in (r.old_fields, r.new_fields)]
            alike = {(sides[0][m["o"]][0], sides[1][m["n"]][0]) for m in (r.matches if r.matches is not None else [])}
            for e in diff(tree(sides[0]), tree(sides[1]), lambda a, b, alike=alike: (a, b) in alike):
                out.append((r.file_id, r.feed_code, r.edition, r.old_id, e.kind, list(e.old), list(e.new), e.old_kind, e.new_kind, e.cost))
        yield pd.DataFrame(out, columns=["file_id", "feed_code", "edition", "old_id", "drift_kind", "old_path", "new_path", "old_kind", "new_kind", "cost"])


def changes(raw: DataFrame, files: DataFrame, key: str = "feature_code") -> DataFrame:
    """Every change of schema from one edition of a feed to the next.

    ``file_id, feed_code, edition, old_id, drift_kind, old_path, new_path, old_kind,
    new_kind, cost``; ``old_id`` is the file compared with, the paths are the names from the
    top down, empty where there is none.

    A first pass reduces the records of a file to its schema tree. Only for fields that
    vanish or appear, at any depth, a second pass compares values: two fields agree when at
    least 95 % of the features in which both have a value have the same, and at least one
    feature has both. The least-cost script between the two trees then names the changes:
    ``renamed`` under matched parents, ``moved`` to another parent, ``added``, ``removed``
    (what lies below goes with it) and ``retyped``.

    First editions have no changes. A file without records has no fields, so all fields of
    the edition before come out as removed. Two files of one feed and edition are both
    compared with each file of the edition before. Repeated records count once per value.
    """
    by_file = profile(raw, key).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("path", "kinds"))).alias("fields"))
    numbered = files.select(F.col("file_id").cast("long"), "feed_code", F.col("edition").cast("int"))
    before = numbered.select(F.col("file_id").alias("old_id"), "feed_code", (F.col("edition") + 1).alias("edition"))
    empty = F.expr("cast(array() as array<struct<path: array<string>, kinds: int>>)")
    sides = cut(  # a row per pair of files, used three times below
        numbered.join(before, ["feed_code", "edition"])
        .join(by_file.withColumnRenamed("fields", "new_fields"), "file_id", "left")
        .join(by_file.select(F.col("file_id").alias("old_id"), F.col("fields").alias("old_fields")), "old_id", "left")
        .withColumns({"new_fields": F.coalesce("new_fields", empty), "old_fields": F.coalesce("old_fields", empty)})
    )

    def only(mine: str, other: str, new: bool) -> Column:
        paths = F.transform(other, lambda f: f["path"])
        numbers = F.transform(mine, lambda f, i: F.struct(F.col("file_id"), F.col("old_id"), F.lit(new).alias("is_new"), i.alias("number"), f["path"].alias("path")))
        return F.filter(numbers, lambda f: ~F.array_contains(paths, f["path"]))

    apart = sides.select("file_id", "old_id", only("old_fields", "new_fields", False).alias("gone"), only("new_fields", "old_fields", True).alias("come"))
    apart = apart.where((F.size("gone") > 0) & (F.size("come") > 0))
    wanted = apart.select(F.col("old_id").alias("__file"), F.col("gone").alias("w")).unionAll(apart.select("file_id", "come"))
    wanted = wanted.groupBy("__file").agg(F.flatten(F.collect_list("w")).alias("wanted"))
    some = raw.select(F.col("file_id").cast("long").alias("__file"), F.col("payload").cast("string").alias("payload")).join(wanted, "__file")
    values = some.select("payload", "wanted").mapInArrow(_values(key), "file_id bigint, old_id bigint, is_new boolean, number int, feature string, lo bigint, hi bigint")
    met = (
        values.groupBy("file_id", "old_id", "feature", "is_new", "number")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .groupBy("file_id", "old_id", "feature")  # as many entries as the two schemas have fields apart
        .agg(F.collect_list(F.struct("is_new", "number", "lo", "hi")).alias("f"))
    )
    olds, news = F.filter("f", lambda x: ~x["is_new"]), F.filter("f", lambda x: x["is_new"])
    both = F.flatten(
        F.transform(
            olds,
            lambda o: F.transform(news, lambda n: F.struct(o["number"].alias("o"), n["number"].alias("n"), ((o["lo"] == n["lo"]) & (o["hi"] == n["hi"])).cast("double").alias("same"))),
        )
    )
    matches = (
        met.select("file_id", "old_id", F.explode(both).alias("m"))
        .groupBy("file_id", "old_id", "m.o", "m.n")
        .agg(F.avg("m.same").alias("share"))
        .where(F.col("share") >= AGREE)
        .groupBy("file_id", "old_id")
        .agg(F.collect_list(F.struct("o", "n")).alias("matches"))
    )
    return sides.join(matches, ["old_id", "file_id"], "left").mapInPandas(_scripts, _CHANGE)


def dotted(found: DataFrame) -> DataFrame:
    """The changes with paths as names with dots: ``old_name, new_name``."""
    names = {n: F.array_join(p, ".") for n, p in (("old_name", "old_path"), ("new_name", "new_path"))}
    return found.withColumns(names).select("file_id", "feed_code", "edition", "drift_kind", "old_name", "new_name", "old_kind", "new_kind", "cost")


def top_level(found: DataFrame) -> DataFrame:
    """The changes of whole fields: ``file_id, drift_kind, old_name, new_name``.

    A whole field that has moved into another one is removed, one that has moved out is added.
    """
    whole = (F.size("old_path") <= 1) & (F.size("new_path") <= 1)
    old, new = (F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise("") for c in ("old_path", "new_path"))
    one_end = F.when(F.size("old_path") == 1, "removed").when(F.size("new_path") == 1, "added")
    kind = F.when(F.col("drift_kind") == "moved", one_end).when(whole, F.col("drift_kind"))
    return found.select("file_id", kind.alias("drift_kind"), old.alias("old_name"), new.alias("new_name")).where("drift_kind is not null")


def lineage(raw: DataFrame, files: DataFrame, found: DataFrame, columns: list[str], key: str = "feature_code") -> DataFrame:
    """The fixed field that each field of each file stands for: ``file_id, path, field``.

    Every field of a file points to what it was in the edition before: the same path, or
    the other end of its rename or move. The pointers are doubled until they reach the first
    edition, so fields of one line have one root. A line stands for the fixed field whose
    name it bears in most files; a line that never bears one stands for the field that other
    lines give its names, by most files. Files and fields are all that is handled here.
    """
    fields = profile(raw, key).select("file_id", "path")
    numbered = files.select(F.col("file_id").cast("long"), "feed_code", F.col("edition").cast("int"))
    before = numbered.select(F.col("file_id").alias("old_id"), "feed_code", (F.col("edition") + 1).alias("edition"))
    previous = numbered.join(before, ["feed_code", "edition"]).groupBy("file_id").agg(F.min("old_id").alias("old_id"))
    linked = found.where(F.col("drift_kind").isin("renamed", "moved")).select("file_id", "old_id", F.col("new_path").alias("path"), "old_path")
    nodes = fields.join(previous, "file_id", "left").join(linked, ["file_id", "old_id", "path"], "left")
    there = fields.select(F.col("file_id").alias("old_id"), F.col("path").alias("old_path"), F.lit(True).alias("there"))
    up = F.when(F.col("there"), F.struct(F.col("old_id").alias("file_id"), F.col("old_path").alias("path"))).otherwise(F.struct("file_id", "path"))
    state = nodes.withColumn("old_path", F.coalesce("old_path", "path")).join(there, ["old_id", "old_path"], "left").select(F.struct("file_id", "path").alias("node"), up.alias("root"))
    state = cut(state.groupBy("node").agg(F.min("root").alias("root")))
    while True:
        further = state.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = cut(state.join(further, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("new")))
        state = after.select("node", "root")
        if after.where("new").limit(1).count() == 0:
            break
    own = F.when(F.size("node.path") == 1, F.get("node.path", F.lit(0)))
    rank = F.array_position(F.array(*map(F.lit, columns)), F.col("field"))
    first = F.max_by("field", F.struct("n", -rank))
    named = state.withColumn("field", own).where(F.col("field").isin(*columns)).groupBy("root", "field").agg(F.count("*").alias("n")).groupBy("root").agg(first.alias("field"))
    placed = state.join(named, "root", "left").select("node", "root", "field")
    votes = placed.where("field is not null").groupBy(F.col("node.path").alias("path"), "field").agg(F.count("*").alias("n"))
    lost = placed.where("field is null").select("root", F.col("node.path").alias("path")).join(votes, "path").groupBy("root", "field").agg(F.sum("n").alias("n")).groupBy("root").agg(first.alias("voted"))
    done = placed.join(lost, "root", "left").select("node.file_id", "node.path", F.coalesce("field", "voted").alias("field"))
    return done.where("field is not null")


def unified(raw: DataFrame, files: DataFrame, found: DataFrame, columns: dict[str, str], key: str = "feature_code") -> DataFrame:
    """All records in one table of fixed columns, whatever their file calls them.

    ``columns`` maps the fixed fields to ``text``, ``long``, ``double`` or ``json``. The
    scripts are compiled into a projection for each file (see :func:`lineage`): where each
    fixed field lies in the records of that file, its own name first. A field is taken from
    the first of these places that gives a value of its type. ``text`` joins the words of an
    array and takes the first text of an object. Everything else stays in the map ``other``
    as JSON: fields without a fixed column, further names of a field in the same record,
    values that are not of the column's type, and objects of which a text was taken. Returns ``file_id, line_no, key``, the fixed
    columns in lower case and ``other``; a payload that cannot be read gives a row of nulls.
    """
    own_first = F.struct((F.col("path") != F.array("field")).alias("far"), "path")
    places = lineage(raw, files, found, list(columns), key).groupBy("file_id", "field").agg(F.transform(F.sort_array(F.collect_list(own_first)), lambda x: x["path"]).alias("paths"))
    by_file = places.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "paths"))).alias("__at"))
    v = F.try_parse_json(F.col("payload"))
    rows = raw.select(F.col("file_id").cast("long"), "line_no", F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v).alias("__v"))
    members = lambda x: F.try_variant_get(x, "$", "map<string,variant>")
    rows = rows.join(by_file, "file_id", "left").withColumn("__m", members(F.col("__v")))

    def at(path: Column) -> Column:
        """The variant at a path below the record."""
        return F.reduce(F.slice(path, 2, 1000), F.try_element_at("__m", F.get(path, F.lit(0))), lambda x, name: F.try_element_at(members(x), name))

    def as_kind(x: Column, kind: str) -> Column:
        if kind == "text":
            words = F.array_join(F.try_variant_get(x, "$", "array<string>"), " ")
            member = F.try_element_at(F.filter(F.map_values(F.try_variant_get(x, "$", "map<string,string>")), lambda w: ~w.rlike(r"^-?[0-9.]+$")), F.lit(1))
            return F.coalesce(words, member, F.try_variant_get(x, "$", "string"))
        return F.when(~F.is_variant_null(x), F.to_json(x)) if kind == "json" else F.try_variant_get(x, "$", kind)

    def got(c: str, kind: str) -> Column:
        paths = F.coalesce(F.try_element_at("__at", F.lit(c)), F.array(F.array(F.lit(c))))
        whole = lambda p: F.lit(True) if kind != "text" else ~F.startswith(F.schema_of_variant(at(p)), F.lit("OBJECT"))
        values = F.transform(paths, lambda p: F.struct(as_kind(at(p), kind).alias("value"), F.when(whole(p), p).alias("path")))
        return F.get(F.filter(values, lambda s: s["value"].isNotNull()), F.lit(0))

    held = {c: f"__c{i}" for i, c in enumerate(columns)}
    rows = rows.withColumns({held[c]: got(c, kind) for c, kind in columns.items()})
    used = F.array_compact(F.array(F.array(F.lit(key)), *[F.col(f"{held[c]}.path") for c in columns]))
    nothing = F.filter(F.map_keys("__m"), lambda k: F.is_variant_null(F.try_element_at("__m", k)))
    rest = F.map_filter(F.try_variant_get("__v", "$", "map<string,string>"), lambda k, _: ~F.array_contains(used, F.array(k)) & ~F.array_contains(nothing, k))
    out = [F.col(f"{held[c]}.value").alias(c.lower()) for c in columns]
    return rows.select("file_id", "line_no", F.try_variant_get(F.try_element_at("__m", F.lit(key)), "$", "string").alias(key), *out, rest.alias("other"))
