"""Probes into JSON text columns."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudinv.schema import PAYLOAD, PAYLOAD_TEXT

_STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]|\['([^']+)'\]")


def _holds_string(json: Column, path: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def with_payload(df: DataFrame, column: str = "configuration") -> DataFrame:
    """Parse a JSON column once, for all later probes, and keep its text beside it.

    Text that a Variant cannot hold (no JSON, a member named twice, too large) is kept apart, and
    probes look at that.
    """
    rows = df.withColumn(PAYLOAD, F.try_parse_json(column))
    return rows.withColumn(PAYLOAD_TEXT, F.when(F.col(PAYLOAD).isNull(), F.col(column)))


def payload_scalar(path: str) -> Column:
    """What :func:`json_scalar` gives for the configuration, from its parsed form."""
    payload, text = F.col(PAYLOAD), F.col(PAYLOAD_TEXT)
    found = F.try_variant_get(payload, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(payload, path, "variant"))
    # A list or object is given as its JSON text, which only its kind tells from a string.
    scalar = F.when(~_container(found), found).when(kind == "STRING", found)
    return F.when(text.isNotNull(), json_scalar(text, path)).otherwise(scalar)


def _container(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def _scalar(text: Column, suspect: Column, json: Column, path: str) -> Column:
    """The text unless it stands for no scalar; suspects are looked at again, to keep
    strings that merely look like an object, an array or null."""
    return F.when(~suspect, text).when(_holds_string(json, path), text)


def json_scalar(json: Column, path: str) -> Column:
    """Text of a scalar member; NULL for a missing, null, object or array member."""
    text = F.get_json_object(json, path)
    # The built-in probe gives the word null for a null within an array.
    return _scalar(text, _container(text) | (text == "null"), json, path)


def json_value(json: Column, path: str) -> Column:
    """Text of any member, objects and arrays as JSON."""
    return F.get_json_object(json, path)


def _steps(path: str) -> list[str | int]:
    found = list(_STEP.finditer(path, 1))
    if not path.startswith("$") or not found or "$" + "".join(m[0] for m in found) != path:
        raise ValueError(f"unsupported path: {path}")
    return [int(m[2]) if m[2] is not None else m[1] or m[3] for m in found]


def _shape(steps: list[str | int]) -> list[str]:
    return ["[]" if isinstance(step, int) else step for step in steps]


def _agree(one: list[str], other: list[str]) -> bool:
    """Both fit one schema: no one leads on into the other, none takes for a list what
    the other takes for an object."""
    for a, b in zip(one, other):
        if a != b:
            return "[]" not in (a, b)
    return len(one) == len(other)


def _tree(paths: list[list[str]]) -> dict:
    root: dict = {}
    for shape in paths:
        node = root
        for step in shape:
            node = node.setdefault(step, {})
    return root


def _type(node: dict) -> T.DataType:
    if not node:
        return T.StringType()
    if "[]" in node:
        return T.ArrayType(_type(node["[]"]))
    return T.StructType([T.StructField(name, _type(child)) for name, child in node.items()])


def _walk(parsed: Column, steps: list[str | int]) -> Column:
    for step in steps:
        parsed = F.get(parsed, F.lit(step)) if isinstance(step, int) else parsed.getField(step)
    return parsed


def with_members(
    df: DataFrame, paths: dict[str, str], column: str = "configuration"
) -> DataFrame:
    """Add scalar members as text columns, all from one parse of the JSON column.

    Exploding a one-element array keeps the parse in a step of its own. A plain column
    would be copied into every filter over a member, and parse again there.

    A path that does not fit into one schema with those before it is probed by itself. Where
    the configuration lies parsed beside its text, members come from there.
    """
    if column == "configuration" and PAYLOAD in df.columns:
        for path in paths.values():
            _steps(path)
        return df.select(*df.columns, *[payload_scalar(path).alias(name) for name, path in paths.items()])
    steps = {name: _steps(path) for name, path in paths.items()}
    parsed: dict[str, list[str]] = {}
    for name, path in steps.items():
        shape = _shape(path)
        if all(_agree(shape, other) for other in parsed.values()):
            parsed[name] = shape
    schema = _type(_tree(list(parsed.values())))
    json = F.col(column)
    document = F.col("_members")

    def member(name: str, path: str) -> Column:
        if name not in parsed:
            return json_scalar(json, path)
        text = _walk(document, steps[name])
        return _scalar(text, _container(text), json, path)

    members = [member(name, path).alias(name) for name, path in paths.items()]
    parse = F.explode(F.array(F.from_json(json, schema))).alias("_members")
    return df.select(*df.columns, parse).select(*df.columns, *members)
