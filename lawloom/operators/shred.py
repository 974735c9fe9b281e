"""Shredding of deeply nested records into an adjacency table, and entity tables pivoted back out of it.

Every record becomes rows (root_id, node, parent, label, ordinal, kind, scalar):

* root_id  digest of the whole record: exact repeats of a record share it, and any other difference changes it
* node     path inside the record, "$" for the record itself; positions are 0-based, as in $.content[2].title
* parent   node of the enclosing object, null for the record itself
* label    field name (the key for a map entry), null for the record itself
* ordinal  position in the enclosing array, -1 outside arrays
* kind     object, scalar, null (a null field or element), empty (an array or map without elements), list (inside a list)
* scalar   the value as text, for kind scalar

One scan and one explode produce all levels: the nodes of a record are built by nested higher-order functions, so
nothing is collected beyond the record itself, and there's no shuffle. A hot or huge record costs its own size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADJACENCY = ("root_id", "node", "parent", "label", "ordinal", "kind", "scalar")


def _node(node: Column, parent: Column, label: Column, ordinal: Column, kind: str, scalar: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if scalar is None else scalar
    return F.struct(node.alias("node"), parent.alias("parent"), label.alias("label"), ordinal.cast("int").alias("ordinal"), F.lit(kind).alias("kind"), value.alias("scalar"))


def _value(value: Column, kind: T.DataType, node: Column, parent: Column, label: Column, ordinal: Column, in_list: bool = False) -> Column:
    """The nodes of one value of any type, as an array."""
    null = F.array(_node(node, parent, label, ordinal, "null"))
    if isinstance(kind, T.StructType):
        own = F.array(_node(node, parent, label, ordinal, "object"))
        filled = F.concat(own, *_fields(value, kind, node)) if kind.fields else own
    elif isinstance(kind, T.ArrayType):
        inner = node if in_list else parent
        items = F.flatten(F.transform(value, lambda x, i: _value(x, kind.elementType, F.concat(node, F.lit("["), i.cast("string"), F.lit("]")), inner, label, i, True)))
        filled = F.when(F.size(value) == 0, F.array(_node(node, parent, label, ordinal, "empty"))).otherwise(items)
        if in_list:  # a list inside a list is a node of its own, as its position would be lost otherwise
            filled = F.concat(F.array(_node(node, parent, label, ordinal, "list")), F.when(F.size(value) == 0, F.slice(items, 1, 0)).otherwise(items))
    elif isinstance(kind, T.MapType):
        items = F.flatten(F.transform(F.map_entries(value), lambda e: _value(e["value"], kind.valueType, F.concat(node, F.lit("{"), e["key"].cast("string"), F.lit("}")), node, e["key"].cast("string"), F.lit(-1))))
        own = F.array(_node(node, parent, label, ordinal, "object"))
        filled = F.when(F.size(value) == 0, F.array(_node(node, parent, label, ordinal, "empty"))).otherwise(F.concat(own, items))
    else:
        text = F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        filled = F.array(_node(node, parent, label, ordinal, "scalar", text))
    return F.when(value.isNull(), null).otherwise(filled)


def _fields(value: Column, kind: T.StructType, node: Column) -> list[Column]:
    return [_value(value.getField(f.name), f.dataType, F.concat(node, F.lit(f".{f.name}")), node, F.lit(f.name), F.lit(-1)) for f in kind.fields]


def shred(records: DataFrame) -> DataFrame:
    """The adjacency table of all records.

    Nulls at any level become nodes of kind null and keep their position; empty arrays become nodes of kind empty. Exact
    repeats of a record give exact repeats of its rows. An empty table gives an empty one. Columns that have the names of
    the result are fields like any other.
    """
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in records.columns])
    kind = T.StructType(records.schema.fields)
    own = records.select(whole.alias("record")).withColumn("root_id", F.md5(F.to_json("record", {"ignoreNullFields": "false"})))
    return own.select("root_id", F.inline(_value(F.col("record"), kind, F.lit("$"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(-1))))


def ordinals(node: Column) -> Column:
    """The array positions along a node's path, outermost first."""
    return F.transform(F.regexp_extract_all(node, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int"))


def entity_table(adjacency: DataFrame, label: str | None, scalars: Sequence[str]) -> DataFrame:
    """One row per object node under the label (None: the records themselves), with its scalar children pivoted to columns.

    Columns: root_id, node, parent, ordinals, then the scalars in their order (null where the field was null); a scalar
    that has the name of one of the first four comes as field_<name>. Repeats of a record count once. Object nodes and their scalar children meet in one join on (root_id, node); both sides are
    spread by record and path, so no entity, however large its record, gathers in a single task.
    """
    named = F.col("label").isNull() if label is None else F.col("label") == label
    objects = adjacency.where(named & (F.col("kind") == "object")).select("root_id", "node", "parent").distinct()
    children = adjacency.where((F.col("kind") == "scalar") & F.col("label").isin(list(scalars)) & (F.col("ordinal") == -1))
    own = ("root_id", "node", "parent", "ordinals")
    names = {s: f"field_{s}" if s in own else s for s in scalars}
    values = children.groupBy("root_id", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == s, F.col("scalar"))).alias(n) for s, n in names.items()])
    return objects.join(values, ["root_id", "node"], "left").select("root_id", "node", "parent", ordinals(F.col("node")).alias("ordinals"), *names.values())
