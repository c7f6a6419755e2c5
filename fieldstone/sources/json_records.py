"""JSON records in and out."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldstone.catalog import Catalog
from fieldstone.operators.quality import check_and_look, check_json, ensure

PRESENT = "_present"


def read_records(
    spark: SparkSession, source: str | DataFrame, catalog: Catalog, model: str, check: bool = True
) -> DataFrame:
    """Records of ``model`` from JSON lines at a path, or from a string column ``value``.

    ``_present`` lists the keys each record really has, so that an absent field and an
    explicit null stay apart. A reference may be given as an object and arrays as lists; both
    keep their nested shape, as deep as the data goes. Text that is no JSON object, unknown
    fields and values of a wrong type raise ``ConstraintError`` with all violations
    (see ``record_violations``); without ``check`` such values read as null. One job over the
    texts finds the violations and what nested shape the records need.
    """
    raw = spark.read.text(source) if isinstance(source, str) else source.select("value")
    found, objects = check_and_look(raw, catalog, model)
    if check:
        ensure(found.where("rule != 'missing_field'"))
    schema = record_schema(catalog, model, objects=objects)
    parsed = raw.select(F.from_json("value", schema).alias("r"), F.json_object_keys("value").alias(PRESENT))
    return parsed.select("r.*", PRESENT)


def record_violations(raw: DataFrame, catalog: Catalog, model: str) -> DataFrame:
    """What keeps JSON texts (column ``value``) from being read as records; a missing field is
    no such thing, since a record may leave it to a default or be a patch."""
    return check_json(raw, catalog, model).where("rule != 'missing_field'")


def record_schema(
    catalog: Catalog, model: str, nested: bool = True, objects: Collection[str] = (), path: str = ""
) -> T.StructType:
    """Input shape of a record. The reference fields whose paths are in ``objects`` hold objects with
    fields beyond the key; other references are objects with the key alone (or, not ``nested``, keys)."""
    fields = []
    for f in catalog.model(model).fields:
        here = f"{path}{f.name}"
        if f.ref_model is None:
            fields.append(T.StructField(f.name, catalog.value_type(f.type)))
        elif nested:
            if here in objects:
                child = record_schema(catalog, f.ref_model, True, objects, f"{here}.")
            else:
                key = catalog.model(f.ref_model).primary
                child = T.StructType([T.StructField(key.name, catalog.value_type(key.type))])
            fields.append(T.StructField(f.name, T.ArrayType(child) if f.is_array else child))
        elif not f.is_array:
            fields.append(T.StructField(f.name, catalog.value_type(f.type)))
    return T.StructType(fields)


def to_response(df: DataFrame, aliases: Mapping[str, str] | None = None, name: str = "json") -> DataFrame:
    """One JSON text per row, fields renamed by ``aliases`` (field -> alias), dates in ISO form."""
    aliases = aliases or {}
    columns = [F.col(f"`{c}`").alias(aliases.get(c, c)) for c in df.columns]
    options = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return df.select(F.to_json(F.struct(*columns), options).alias(name))
