"""Schemas that drift between files: fingerprints, migration steps and one consistent table.

Each file of a feed has a fingerprint of its fields and types; files in a row with one fingerprint share a version.
Only where the fingerprint changes are two files compared: the difference of their field lists gives the steps added,
removed, retyped and renamed. Chained from a file to the feed's last one, the renames route each record to the feed's
current names; casts and defaults do the rest, and what has no form in the current type is reported.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.common import materialize, once, parse_json


def json_type(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "string"
    return "object" if isinstance(v, dict) else "array"


def fields_of(record: dict, wanted: set[str] | None = None) -> Iterator[tuple[str, str, object]]:
    """Path, type and value of the non-null fields, at any depth; list elements are no fields."""
    todo = [("", record)]
    while todo:
        at, o = todo.pop()
        for k, v in o.items():
            if v is None:
                continue
            path = f"{at}.{k}" if at else k
            if wanted is None or path in wanted:
                yield path, json_type(v), v
            if isinstance(v, dict):
                todo.append((path, v))


def canonical(v) -> str:
    """Equal JSON values give equal texts: 1 and 1.0 are one number, the order of an object's fields is no matter."""
    out, todo = [], [v]
    while todo:
        v = todo.pop()
        if isinstance(v, _Sign):
            out.append(v)
        elif isinstance(v, bool) or v is None or isinstance(v, str):
            out.append(json.dumps(v))
        elif isinstance(v, float):
            out.append(json.dumps(v) if v != v or abs(v) == float("inf") else str(int(v)) if v == int(v) else repr(v))
        elif isinstance(v, int):
            out.append(str(v))
        else:
            keyed = isinstance(v, dict)
            parts = [_Sign("{" if keyed else "[")]
            for i, x in enumerate(sorted(v) if keyed else v):
                parts.append(_Sign("," if i else ""))
                parts += [_Sign(json.dumps(x) + ":"), v[x]] if keyed else [x]
            todo.extend(reversed([*parts, _Sign("}" if keyed else "]")]))
    return "".join(out)


class _Sign(str):
    """Punctuation between the values of :func:`canonical`."""


def parsed(text: str | None) -> dict | None:
    """The object in ``text``; None for null, empty, unreadable or other content."""
    try:
        o = parse_json(text) if text else None
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def file_texts(rows: DataFrame, feed: str = "feed", file_no: str = "file_no", text: str = "meta", key: str = "result_id") -> DataFrame:
    """``feed, file_no, text`` of all rows with a key, for questions to which a repeated row is no matter: what fields
    and values a file has. Nothing is shuffled."""
    out = rows.filter(F.col(key).isNotNull()).select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), F.col(text).alias("text"))
    return out.filter("feed is not null and file_no is not null")


def file_records(rows: DataFrame, feed: str = "feed", file_no: str = "file_no", text: str = "meta", key: str = "result_id", order: str = "ingested_at") -> DataFrame:
    """``key, feed, file_no, text``, each key once, rows without a feed or file left out."""
    out = rows.select(F.col(key).alias("key"), F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), F.col(text).alias("text"), F.col(order).alias("__o"))
    return out.filter("feed is not null and file_no is not null").transform(once, "key", "__o").drop("__o")


def file_fields(records: DataFrame) -> DataFrame:
    """``feed, file_no, path, parent, types``: the fields of each file with the set of their types, sorted.

    Tasks reduce their own rows first: what is shuffled grows with files x fields, not with records. A file without
    any field has one row with a null path.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()
        for b in batches:
            for feed, no, text in zip(b["feed"], b["file_no"], b["text"]):
                seen.add((feed, no, None, None))
                for path, kind, _ in fields_of(parsed(text) or {}):
                    seen.add((feed, no, path, kind))
            if len(seen) > 200_000:
                yield pd.DataFrame(list(seen), columns=["feed", "file_no", "path", "type"])
                seen = set()
        if seen:
            yield pd.DataFrame(list(seen), columns=["feed", "file_no", "path", "type"])

    rows = records.select("feed", "file_no", "text").mapInPandas(run, "feed string, file_no int, path string, type string")
    types = F.array_join(F.array_sort(F.collect_set("type")), "|")
    parent = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1)
    return rows.groupBy("feed", "file_no", "path").agg(types.alias("types")).withColumn("parent", parent)


def field_values(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """``feed, file_no, path, value``: the distinct values (as 64-bit hashes) of the fields in ``wanted``
    (``feed, file_no, paths``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple] = set()

        def rows() -> pd.DataFrame:
            return pd.DataFrame(list(seen), columns=["feed", "file_no", "path", "value"])

        for b in batches:
            for feed, no, text, paths in zip(b["feed"], b["file_no"], b["text"], b["paths"]):
                for path, _, v in fields_of(parsed(text) or {}, set(paths)):
                    seen.add((feed, no, path, xxhash.xxh64_intdigest(canonical(v)) - (1 << 63)))
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    rows = records.join(wanted, ["feed", "file_no"]).select("feed", "file_no", "text", "paths")
    return rows.mapInPandas(run, "feed string, file_no int, path string, value bigint").distinct()


def changes(records: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """``feed, file_no, change_kind, field, new_field``: each change from file ``file_no`` - 1 to ``file_no``.

    ``records`` are those of :func:`file_texts` or :func:`file_records`. Files of equal fingerprints are not compared. A field that has several types in one file has them all as its
    type. Where one gone field shares values with several new ones (or the reverse), each such pair is a rename.
    Files whose predecessor has no row at all are not compared; a file of only null, empty or unreadable records has
    no fields. An empty table gives an empty result.
    """
    fields = materialize(file_fields(records), "fields") if fields is None else fields
    prints = versions(fields).select("feed", "file_no", "fingerprint")
    before = prints.select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("fingerprint").alias("was"))
    pairs = materialize(prints.join(before, ["feed", "file_no"]).filter("fingerprint <> was").select("feed", "file_no"), "pairs")
    some = fields.filter("path is not null")
    now = some.join(pairs, ["feed", "file_no"])
    before = some.withColumn("file_no", F.col("file_no") + 1).join(pairs, ["feed", "file_no"])
    diff = now.alias("n").join(before.alias("b"), ["feed", "file_no", "path"], "full")
    kind = F.when(F.col("b.types").isNull(), "added").when(F.col("n.types").isNull(), "removed").when(F.col("b.types") != F.col("n.types"), "retyped")
    diff = diff.select("feed", "file_no", "path", F.coalesce("n.parent", "b.parent").alias("parent"), F.coalesce("n.types", "b.types").alias("types"), kind.alias("kind")).filter("kind is not null")
    # Leave out what lies inside a changed object: explode the paths above a field and look each up.
    parts = F.split("parent", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    inside = diff.filter("parent <> ''").select("feed", "file_no", "path", F.explode(above).alias("up"))
    changed = diff.select("feed", "file_no", F.col("path").alias("up"))
    inside = inside.join(changed, ["feed", "file_no", "up"], "left_semi").select("feed", "file_no", "path").distinct()
    diff = materialize(diff.join(inside, ["feed", "file_no", "path"], "left_anti"), "diff")
    # Only gone and new fields with a counterpart of one parent and type can be renames; only their values are read.
    group = ["feed", "file_no", "parent", "types"]
    both = diff.filter("kind <> 'retyped'").groupBy(*group).agg(F.countDistinct("kind").alias("n")).filter("n = 2").drop("n")
    maybe = diff.filter("kind <> 'retyped'").join(both, group, "left_semi").withColumn("at", F.col("file_no") - F.when(F.col("kind") == "removed", 1).otherwise(0))
    wanted = maybe.groupBy("feed", F.col("at").alias("file_no")).agg(F.collect_set("path").alias("paths"))
    values = field_values(records, wanted).withColumnRenamed("file_no", "at")
    values = materialize(maybe.join(values, ["feed", "at", "path"]), "values")
    gone = values.filter("kind = 'removed'").select(*group, "value", F.col("path").alias("field"))
    new = values.filter("kind = 'added'").select(*group, "value", F.col("path").alias("new_field"))
    renamed = gone.join(new, [*group, "value"]).select("feed", "file_no", "field", "new_field").distinct()
    ends = renamed.select("feed", "file_no", F.explode(F.array(F.struct(F.col("field").alias("path"), F.lit("removed").alias("kind")), F.struct(F.col("new_field").alias("path"), F.lit("added").alias("kind")))).alias("e"))
    ends = ends.select("feed", "file_no", "e.path", "e.kind").distinct()
    rest = diff.join(ends, ["feed", "file_no", "path", "kind"], "left_anti")
    return rest.select("feed", "file_no", F.col("kind").alias("change_kind"), F.col("path").alias("field"), F.lit("").alias("new_field")).unionByName(
        renamed.select("feed", "file_no", F.lit("renamed").alias("change_kind"), "field", "new_field")
    )


def versions(fields: DataFrame) -> DataFrame:
    """``feed, file_no, fingerprint, version``: files in a row with equal fields and types share a version, from 1.

    The window is over the files of a feed, never over its records.
    """
    prints = fields.groupBy("feed", "file_no").agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "path", "types"))), "\n")).alias("fingerprint"))
    w = Window.partitionBy("feed").orderBy("file_no")
    step = (F.col("fingerprint") != F.lag("fingerprint").over(w)).cast("int")
    return prints.withColumn("__s", F.coalesce(step, F.lit(1))).withColumn("version", F.sum("__s").over(w).cast("int")).drop("__s")


def routes(steps: DataFrame, fields: DataFrame) -> DataFrame:
    """``feed, file_no, rules, current``: for each file the chained rules as JSON, ``{"rename": {old: current}, "cast":
    {...}, "default": [...]}`` (``default``: current fields that the file lacks), and the feed's current fields with
    their types.

    One group per feed over its steps and fields, both bounded by the feed's schemas. A field that splits into several
    names takes the first by name; one that vanishes keeps its last name and type.
    """

    def run(key, s: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        f = f.dropna(subset=["path"]) if len(f.dropna(subset=["path"])) else f
        last_type, last_file = {}, {}
        for r in f.dropna(subset=["path"]).sort_values("file_no").itertuples():
            last_type[r.path], last_file[r.path] = r.types, r.file_no
        hops: dict[int, dict[str, str]] = {}
        for r in s[s.change_kind == "renamed"].sort_values(["file_no", "field", "new_field"]).itertuples():
            hops.setdefault(r.file_no, {}).setdefault(r.field, r.new_field)
        names: dict[str, str] = {}
        rows, current = [], {}
        for no in sorted(f.file_no.unique(), reverse=True):
            # names: from a name in this file to the current one
            cast, have = {}, set()
            for r in f[(f.file_no == no) & f.path.notna()].itertuples():
                to = renamed_path(r.path, names)
                have.add(to)
                want = last_type.get(to, r.types)
                current.setdefault(to, want)
                if want != r.types:
                    cast[r.path] = want
            rows.append((int(no), {a: b for a, b in names.items() if a != b}, cast, have))
            if no in hops:
                names = {**names, **{a: renamed_path(b, names) for a, b in hops[no].items()}}
        plain = {p: t for p, t in current.items() if t != "object"}
        # What lay inside an object that is a value now goes with it.
        plain = {p: t for p, t in plain.items() if not any(p[:i] in plain for i, c in enumerate(p) if c == ".")}
        text = json.dumps(plain, sort_keys=True)
        out = [(key[0], no, json.dumps({"rename": names, "cast": cast, "default": sorted(plain.keys() - have)}), text) for no, names, cast, have in rows]
        return pd.DataFrame(out, columns=["feed", "file_no", "rules", "current"])

    return steps.groupBy("feed").cogroup(fields.groupBy("feed")).applyInPandas(run, "feed string, file_no int, rules string, current string")


def renamed_path(path: str, names: dict[str, str]) -> str:
    """The current name of a path: its own, or that of the object above it, which takes its fields along."""
    cut = path
    while cut not in names:
        if "." not in cut:
            return path
        cut = cut.rpartition(".")[0]
    return names[cut] + path[len(cut) :]


class NoForm(ValueError):
    """A value that the wanted type cannot hold."""


def cast_value(v, want: str):
    """``v`` as the wanted JSON type; of several types (``number|string``) the first that can hold it. NoForm where none
    can: an unreadable number, a list of several values as a scalar, an object as anything but a string or array."""
    kinds = want.split("|")
    if v is None or json_type(v) in kinds:
        return v
    for kind in kinds:
        if kind == "string":
            return canonical(v)
        if kind == "array":
            return [v]
        if isinstance(v, list):
            if len(v) == 1 and not isinstance(v[0], list):
                return cast_value(v[0], want)
        elif kind == "number" and not isinstance(v, dict):
            try:
                return float(v)
            except ValueError:
                pass
        elif kind == "boolean" and isinstance(v, str) and v.strip().lower() in ("true", "false"):
            return v.strip().lower() == "true"
    raise NoForm(f"{json_type(v)} as {want}")


def routed(record: dict, rules: dict, current: dict, defaults: dict) -> tuple[dict, list[tuple[str, str, str]]]:
    """A record under current names and types, flat, and what was lost: ``(field, value, wanted type)``."""
    flat, lost = {}, []
    for path, kind, v in fields_of(record):
        to = renamed_path(path, rules["rename"])
        up = to
        while "." in up and up not in current:
            up = up.rpartition(".")[0]
        if kind == "object" and to not in current or up != to and up in current:
            continue  # its fields have paths of their own, or the object above it was cast as a whole
        want = rules["cast"].get(path) or current.get(to, kind)
        if want == "object":  # a value where records have an object now
            lost.append((to, canonical(v), want))
            continue
        try:
            flat[to] = cast_value(v, want)
        except NoForm:
            flat[to] = None
            lost.append((to, canonical(v), want))
    for path in rules["default"]:
        flat.setdefault(path, defaults.get(path))
    return flat, lost


def unify(records: DataFrame, defaults: dict | None = None) -> DataFrame:
    """``key, feed, file_no, version, record, lost``: every record under its feed's current names and types.

    ``record`` is a flat JSON object from path to value. A current field that the record's whole file lacks has its
    value in ``defaults`` (by path), else null. Values that have no form in the current type are null in the record and
    stand in ``lost`` (``field, value, wanted``), so nothing is dropped unseen. Null and unreadable texts give only defaults.
    """
    defaults = defaults or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, rows in _routed_batches(batches, defaults):
            yield b[["key", "feed", "file_no", "version"]].assign(record=[canonical(f) for f, _ in rows], lost=[[dict(zip(("field", "value", "wanted"), x)) for x in lost] for _, lost in rows])

    return _routes_of(records).mapInPandas(run, "key bigint, feed string, file_no int, version int, record string, lost array<struct<field:string,value:string,wanted:string>>")


def lost_values(unified: DataFrame) -> DataFrame:
    """``feed, file_no, field, wanted, n``: how often a value of a file had no form in the current type, from :func:`unify`."""
    rows = unified.select("feed", "file_no", F.explode("lost").alias("l"))
    return rows.groupBy("feed", "file_no", F.col("l.field").alias("field"), F.col("l.wanted").alias("wanted")).agg(F.count("*").alias("n"))


def unified_table(records: DataFrame, defaults: dict | None = None) -> DataFrame:
    """:func:`unify` as one table with a typed column per current field of any feed (``a.b`` becomes ``a__b``).

    Numbers are double, booleans boolean; a field whose type differs between feeds, or is a list, is JSON text. The
    driver holds the field list, which is as large as the schemas.
    """
    routes_of = _routes_of(records)
    kinds: dict[str, set] = {}
    for r in routes_of.select("current").distinct().collect():  # a row per feed
        for path, kind in json.loads(r["current"]).items():
            kinds.setdefault(path, set()).add(kind)
    taken = {"key", "feed", "file_no", "version"}
    columns: dict[str, tuple[str, str]] = {}
    for path in sorted(kinds):
        name = "".join(c if c.isalnum() or c == "_" else "_" for c in path.replace(".", "__"))
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        columns[path] = name, {frozenset(["number"]): "double", frozenset(["boolean"]): "boolean"}.get(frozenset(kinds[path]), "string")
    whole = {p for p, k in kinds.items() if k == {"string"}}

    def shown(path: str, kind: str, v):
        return v if v is None or kind != "string" or path in whole else canonical(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, rows in _routed_batches(batches, defaults or {}):
            out = b[["key", "feed", "file_no", "version"]]
            more = {name: pd.Series([shown(path, kind, f.get(path)) for f, _ in rows], index=b.index, dtype="Float64" if kind == "double" else "boolean" if kind == "boolean" else object) for path, (name, kind) in columns.items()}
            yield pd.concat([out, pd.DataFrame(more, index=b.index)], axis=1)

    return routes_of.mapInPandas(run, ", ".join(["key bigint, feed string, file_no int, version int", *[f"`{n}` {k}" for n, k in columns.values()]]))


def _routes_of(records: DataFrame) -> DataFrame:
    """``records`` with the version and rules of their files."""
    fields = materialize(file_fields(records), "fields")
    steps = materialize(changes(records, fields), "steps")
    rules = routes(steps, fields).join(versions(fields).select("feed", "file_no", "version"), ["feed", "file_no"])
    rows = records.join(materialize(rules, "rules"), ["feed", "file_no"])
    return rows.select("key", "feed", "file_no", "version", "text", "rules", "current")


def _routed_batches(batches: Iterator[pd.DataFrame], defaults: dict) -> Iterator[tuple[pd.DataFrame, list]]:
    known: dict[tuple, tuple] = {}
    for b in batches:
        rows = []
        for text, rule, current in zip(b["text"], b["rules"], b["current"]):
            if (rule, current) not in known:
                known = {} if len(known) > 10_000 else known
                known[rule, current] = json.loads(rule), json.loads(current)
            rows.append(routed(parsed(text) or {}, *known[rule, current], defaults))
        yield b, rows
