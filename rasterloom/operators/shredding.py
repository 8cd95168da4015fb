"""Nested records to related flat tables by adjacency-table shredding.

Every value of a document becomes a row of one adjacency table: node, parent, label, ordinal and scalar. Nodes that are
objects of an entity (a model, a point, a tile, ...) also carry the chain of entity nodes above them, so a parent-child
link at any depth is an equi-join, not a recursion. An entity table joins its object nodes with all values below them
that belong to no entity further down: its own fields are pivoted, the rest, nested or unknown, goes by path to a map.

Shapes that vary are made alike while shredding: a part given as JSON inside a string is opened; an entity's list may
also be an object keyed by name or position, or the lone object itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.common import materialize, parse_json


@dataclass(frozen=True)
class Entity:
    """Objects found under ``label`` are rows of entity ``name``.

    ``lone_if`` names fields that only an entity object has: an object with one of them is itself the entity, one
    without is keyed by name. Where it is empty, an object is keyed only if all its keys are whole numbers.
    """

    label: str
    name: str
    fields: tuple[str, ...] = ()
    lone_if: frozenset[str] = field(default_factory=frozenset)


MANIFEST = (
    Entity("spatials", "spatial", ("type", "minlon", "minlat", "maxlon", "maxlat", "lon", "lat", "buffer_m", "crs")),
    Entity("models", "model", ("model", "status", "error"), frozenset({"model", "metas", "sensor"})),
    Entity("metas", "point", ("model", "image_size")),
    Entity("tiles", "tile", ("row", "col", "valid_h", "valid_w")),
    Entity("frames", "frame", ("t", "start", "end", "empty")),
    Entity("issues", "issue", ("code", "band")),
)
NODES = "doc bigint, node int, parent int, label string, ordinal int, kind string, scalar string, entity string, key string, chain array<int>, path string, leaf boolean"


def opened(value):
    """``value``, or what it holds if it is a string with a JSON object or list inside."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = parse_json(value)
        except ValueError:
            break
    return value


def elements(value, entity: Entity) -> list[tuple[int, str | None, object]]:
    """Position, key and value of the elements of an entity's list in any of its shapes."""
    value = opened(value)
    if isinstance(value, list):
        return [(i, None, opened(v)) for i, v in enumerate(value)]
    if isinstance(value, dict):
        if entity.lone_if:
            keyed = bool(value) and not entity.lone_if & value.keys()
        else:
            keyed = bool(value) and all(k.isdecimal() for k in value)
        if keyed:
            return [(int(k) if k.isdecimal() else i, k, opened(v)) for i, (k, v) in enumerate(value.items())]
        return [(0, None, value)]
    return []


def shred_one(doc: int, text: str | None, entities: dict[str, Entity], out: list[tuple], only: frozenset[str] | None = None) -> None:
    """Append the nodes of one document, in document order; nothing for an unreadable one, however deep it is nested.

    ``only``: of the values that are no entity, those of these paths (below the lowest entity) alone.
    """
    try:
        root = parse_json(text) if text else None
    except ValueError:
        return
    root = opened(root)
    if not isinstance(root, (dict, list)):
        return
    # value, parent, label, ordinal, key, entity, chain of entity nodes above, path from the lowest of these
    todo = [(root, None, None, 0, None, None, (), "")]
    node = 0
    while todo:
        value, parent, label, ordinal, key, entity, chain, path = todo.pop()
        me, node = node, node + 1
        scalar = None
        below: list[tuple] = []
        if isinstance(value, dict):
            kind, inner = "object", (*chain, me) if entity else chain
            base = "" if entity else path
            for i, (k, v) in enumerate(value.items()):
                at = _step(base, k)
                if (e := entities.get(k)) is not None and not isinstance(o := opened(v), (int, float, str, type(None))):
                    below.append((_List(elements(o, e), e.name), me, k, i, None, None, inner, at))
                else:
                    v = opened(v) if isinstance(v, str) else v
                    below.append((v, me, k, i, None, None, inner, at))
        elif isinstance(value, _List):
            kind = "array"
            below = [(v, me, label, pos, k, value.entity if isinstance(v, dict) else None, chain, f"{path}[{pos}]" if k is None else _step(path, k)) for pos, k, v in value.items]
        elif isinstance(value, list):
            kind = "array"
            if only is not None and not any(isinstance(v, (dict, list, str)) for v in value):
                continue  # no entity below
            below = [(v, me, label, i, None, None, chain, f"{path}[{i}]") for i, v in enumerate(value)]
        elif value is None:
            kind = "null"
        elif isinstance(value, bool):
            kind, scalar = "boolean", "true" if value else "false"
        elif isinstance(value, (int, float)):
            kind, scalar = "number", repr(value)
        else:
            kind, scalar = "string", value
        if only is None or entity or path in only:
            out.append((doc, me, parent, label, ordinal, kind, scalar, entity, key, list(chain), path, not below and entity is None))
        todo.extend(reversed(below))


def _step(path: str, name: str) -> str:
    """``path`` and a field below it; names with signs of a path are quoted, so that no two paths are the same."""
    if not name or any(c in name for c in '.[]"'):
        return f"{path}[{json.dumps(name)}]"
    return f"{path}.{name}" if path else name


class _List:
    """An entity's list, brought to one shape."""

    def __init__(self, items: list, entity: str) -> None:
        self.items, self.entity = items, entity


def shred(docs: DataFrame, key: str, text: str, entities: tuple[Entity, ...] = MANIFEST, only: tuple[str, ...] | None = None) -> DataFrame:
    """The adjacency table of ``docs``: one row per value, ``doc`` being the document's ``key``; with ``only``, the
    entities and of the other values those of these paths.

    Node numbers follow the order of the document, the root is 0 and has no parent. Null, empty and unreadable texts
    give no rows, null elements are nodes of kind ``null`` without entity; an empty table gives an empty result.
    Other columns are ignored. ``key`` must be unique: see :func:`readable_once`.
    """
    by_label = {e.label: e for e in entities}
    paths = None if only is None else frozenset(only)
    columns = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc, t in zip(b["doc"], b["text"]):
                shred_one(int(doc), t, by_label, out, paths)
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=columns).astype({"parent": "Int32"})
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns).astype({"parent": "Int32"})

    return docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc is not null").mapInPandas(run, NODES)


def readable_once(docs: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """One row per ``key``: the earliest that can be read, else the earliest. Rows with a null key are left out."""
    rest = [c for c in docs.columns if c != key]
    rank = F.struct(F.expr(f"try_parse_json(`{text}`)").isNull(), F.col(order).isNull(), F.col(order))
    return docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("__r")).select(key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def entity_table(nodes: DataFrame, entity: Entity) -> DataFrame:
    """One row per object of ``entity``: ``doc, node, chain, position, key``, its scalar fields as strings and ``extra``.

    The map ``extra`` holds by path every other value below the object that belongs to no entity further down: unknown
    fields and whatever is nested in objects and lists (``temporal.end.name``, ``bands[0]``), nulls as null, empty objects
    and lists as ``{}`` and ``[]``. The root counts as an object above all entities.
    """
    objects = nodes.filter(F.col("entity") == entity.name).select("doc", "node", "chain", F.col("ordinal").alias("position"), "key")
    owner = F.coalesce(F.try_element_at("chain", F.lit(-1)), F.lit(0))
    value = F.coalesce("scalar", F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]"))
    values = nodes.filter(F.col("leaf") & F.col("parent").isNotNull()).select("doc", owner.alias("node"), "path", "scalar", value.alias("value"))
    fields = [F.max(F.when(F.col("path") == f, F.col("scalar"))).alias(f) for f in entity.fields]
    known = (F.col("path").isin(*entity.fields) & F.col("scalar").isNotNull()) if entity.fields else F.lit(False)
    extra = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull() & ~known, F.struct("path", "value"))))).alias("extra")
    rows = objects.join(values, ["doc", "node"], "left")
    return rows.groupBy("doc", "node").agg(
        F.first("chain").alias("chain"), F.first("position").alias("position"), F.first("key").alias("key"), *fields, extra
    )


def manifest_tables(manifests: DataFrame, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """``exports, spatials, models, points, tiles, frames, issues`` of the manifests; each child row names its parents.

    Whatever has no column of its own is in ``extra``, see :func:`entity_table`. A model's name is its field ``model``,
    else its key; what a point itself says is ``own_model``. Of re-delivered rows the earliest readable counts.
    """
    docs = readable_once(manifests, "export_id", "manifest", "ingested_at")
    nodes = materialize(shred(docs, "export_id", "manifest"), "nodes") if nodes is None else nodes
    by_name = {e.name: e for e in MANIFEST}
    top = Entity("", "export", ("created_at", "package_version", "status", "backend", "n_items", "layout"))
    exports = entity_table(nodes.filter("size(chain) = 0").withColumn("entity", F.when(F.col("parent").isNull(), "export")), top)
    models = entity_table(nodes, by_name["model"])
    models = models.select(F.col("doc").alias("export_id"), F.col("node").alias("model_node"), F.coalesce("model", "key").alias("model"), F.col("position").alias("model_pos"), "status", "error", "extra")
    points = entity_table(nodes, by_name["point"]).select(
        F.col("doc").alias("export_id"), F.col("node").alias("point_node"), F.explode("chain").alias("model_node"), F.col("position").alias("point_index"), F.col("image_size").cast("int").alias("image_size"), F.col("model").alias("own_model"), "extra"
    )
    points = points.join(models.select("export_id", "model_node", "model"), ["export_id", "model_node"])
    spatials = entity_table(nodes, by_name["spatial"])
    number = lambda f: F.col(f) if f in ("type", "crs") else F.expr(f"try_cast(`{f}` as double)").alias(f)
    spatials = spatials.select(F.col("doc").alias("export_id"), F.col("node").alias("spatial_node"), F.col("position").alias("spatial_pos"), *[number(f) for f in by_name["spatial"].fields], "extra")
    tables = {
        "exports": exports.select(F.col("doc").alias("export_id"), "layout", F.expr("try_cast(n_items as int)").alias("n_items"), "created_at", "package_version", "status", "backend", "extra"),
        "spatials": spatials,
        "models": models,
        "points": points,
    }
    link = points.select("export_id", "point_node", "model", "point_index")
    for name, casts in (("tile", {"row": "int", "col": "int", "valid_h": "int", "valid_w": "int"}), ("frame", {"t": "int", "empty": "boolean"}), ("issue", {})):
        rows = entity_table(nodes, by_name[name]).withColumn("point_node", F.explode("chain")).withColumnRenamed("doc", "export_id")
        fields = [F.expr(f"try_cast(`{f}` as {casts[f]})").alias(f) if f in casts else F.col(f) for f in by_name[name].fields]
        tables[f"{name}s"] = rows.join(link, ["export_id", "point_node"]).select("export_id", "model", "point_index", "point_node", F.col("node").alias("child_node"), F.col("position").alias("child_pos"), *fields, "extra")
    return tables


def manifest_children(manifests: DataFrame) -> DataFrame:
    """``export_id, model, point_index, child_kind, child_pos`` of each tile, frame and issue below a point, once each.

    The links are those of :func:`manifest_tables`, read from the adjacency table without the children's fields.
    """
    docs = readable_once(manifests, "export_id", "manifest", "ingested_at")
    kept = materialize(shred(docs, "export_id", "manifest", only=("model",)), "nodes")
    models = entity_table(kept.filter("coalesce(entity, 'model') = 'model'"), next(e for e in MANIFEST if e.name == "model"))
    models = models.select(F.col("doc").alias("export_id"), F.col("node").alias("model_node"), F.coalesce("model", "key").alias("model"))
    points = kept.filter("entity = 'point'").select(F.col("doc").alias("export_id"), F.col("node").alias("point_node"), F.col("ordinal").alias("point_index"), F.explode("chain").alias("model_node"))
    children = kept.filter("entity in ('tile', 'frame', 'issue')").select(F.col("doc").alias("export_id"), F.explode("chain").alias("point_node"), F.col("entity").alias("child_kind"), F.col("ordinal").alias("child_pos"))
    rows = children.join(points, ["export_id", "point_node"]).join(models, ["export_id", "model_node"])
    return rows.select("export_id", "model", "point_index", "child_kind", "child_pos").distinct()


META = (
    Entity("sensor", "sensor", ("collection", "reducer"), frozenset({"collection", "bands", "scale_m"})),
    Entity("temporal", "temporal", ("mode", "start", "end", "n_bins"), frozenset({"mode", "start", "end"})),
    Entity("provider", "provider", ("name",), frozenset({"name"})),
    Entity("quality", "quality"),
    Entity("input_quality", "input_quality"),
)


def _metas(results: DataFrame) -> DataFrame:
    return readable_once(results.select("result_id", "meta", "ingested_at"), "result_id", "meta", "ingested_at")


def meta_nodes(results: DataFrame) -> DataFrame:
    """One row per value of a result's ``meta``, objects and lists too, so that every ``parent`` is a ``node`` of the
    result: ``result_id, node, parent, label, ordinal, kind, scalar, path``. ``path`` leads there from the root."""
    return shred(_metas(results), "result_id", "meta", ()).select(F.col("doc").alias("result_id"), "node", "parent", "label", "ordinal", "kind", "scalar", "path")


def meta_tables(results: DataFrame) -> dict[str, DataFrame]:
    """``result`` (the root) and the entities of ``META``, pivoted as those of the manifests, each row with the
    ``parent_node`` of the entity above it (0: the result) and ``extra``, see :func:`entity_table`."""
    nodes = materialize(shred(_metas(results), "result_id", "meta", META), "nodes")
    root = Entity("", "result", ("model", "source", "image_size", "checkpoint", "latency_ms", "pool_mode", "y_axis_direction", "n_tokens"))
    roots = nodes.filter("size(chain) = 0").withColumn("entity", F.when(F.col("parent").isNull(), "result"))
    above = F.coalesce(F.try_element_at("chain", F.lit(-1)), F.lit(0)).alias("parent_node")
    out = {"result": entity_table(roots, root).select(F.col("doc").alias("result_id"), "node", *root.fields, "extra")}
    for e in META:
        out[e.name] = entity_table(nodes, e).select(F.col("doc").alias("result_id"), "node", above, "position", "key", *e.fields, "extra")
    return out


def meta_table(results: DataFrame) -> DataFrame:
    """The scalars of :func:`meta_nodes`: ``result_id, node, parent, label, ordinal, kind, scalar``."""
    return meta_nodes(results).filter("scalar is not null").drop("path")
