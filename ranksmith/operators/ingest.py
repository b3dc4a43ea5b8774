"""Ingest transforms: embedding fields, sparse encoding, semantic fields and reuse of unchanged embeddings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.functions import sparse
from ranksmith.operators.models import ModelRegistry

MAX_DEPTH = 20
SEMANTIC_SUFFIX = "_semantic_info"
SPARSE_PRUNE_TYPE, SPARSE_PRUNE_RATIO = "max_ratio", 0.1


def unflatten(document: Mapping) -> dict:
    """Dotted keys to nested maps: ``{"a.b": 1}`` is ``{"a": {"b": 1}}``. Clashing paths are errors."""
    out: dict = {}
    for key, value in document.items():
        value = unflatten(value) if isinstance(value, Mapping) else [unflatten(x) if isinstance(x, Mapping) else x for x in value] if isinstance(value, list) else value
        if not key or key.startswith(".") or key.endswith(".") or ".." in key:
            raise ValueError(f"bad field name {key!r}")
        *path, last = key.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"{key!r} clashes with another field")
        if isinstance(at.get(last), dict) and isinstance(value, dict):
            at[last] = {**at[last], **value}
        else:
            at[last] = value
    return out


def validate_leaf(value, path: str = "field", max_depth: int = MAX_DEPTH) -> None:
    """A field to embed is a non-empty string, a list of such strings, or a map of such fields, of limited depth."""
    if max_depth < 0:
        raise ValueError(f"{path} is nested too deep")
    if isinstance(value, str):
        if not value.strip():
            raise ValueError(f"{path} has empty string value")
    elif isinstance(value, list):
        for x in value:
            if isinstance(x, Mapping):
                validate_leaf(x, path, max_depth - 1)
            elif x is None:
                raise ValueError(f"{path} list has null")
            elif not isinstance(x, str):
                raise ValueError(f"{path} list has a value that is no string")
            elif not x.strip():
                raise ValueError(f"{path} list has empty string value")
    elif isinstance(value, Mapping):
        for k, v in value.items():
            if v is not None:
                validate_leaf(v, f"{path}.{k}", max_depth - 1)
    elif value is not None:
        raise ValueError(f"{path} is neither a string nor a list or map of them")


def blank_to_null(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, text)


def text_embedding(df: DataFrame, registry: ModelRegistry, model_id: str, field_map: Mapping[str, str]) -> DataFrame:
    """Embeds text columns into vector columns. A list column becomes a list of ``{knn: vector}``, whose elements are embedded where
    the row is."""
    out = df
    for source, target in field_map.items():
        if isinstance(df.schema[source].dataType, T.ArrayType):
            out = out.withColumn(target, F.transform(registry.list_column(model_id, F.col(source)), lambda v: F.struct(v.alias("knn"))))
        else:
            out = out.withColumn(target, registry.column(model_id, blank_to_null(F.col(source))))
    return out


def image_embedding(df: DataFrame, registry: ModelRegistry, model_id: str, target: str, text: str | None = None, image: str | None = None) -> DataFrame:
    """One vector from a text, an image (base64 text), or both."""
    inputs = [F.col(c) if c else F.lit(None).cast("string") for c in (text, image)]
    if text is None and image is None:
        raise ValueError("a text or an image column is needed")
    return df.withColumn(target, registry.column(model_id, *inputs))


def sparse_encoding(df: DataFrame, encoder: Callable[[Column], Column], field_map: Mapping[str, str], prune_type: str = "none", prune_ratio: float | None = None) -> DataFrame:
    """Encodes text columns into token-weight maps and prunes them."""
    sparse.check_prune(prune_type, prune_ratio)
    return df.withColumns({target: sparse.prune(encoder(F.col(source)), prune_type, prune_ratio) for source, target in field_map.items()})


def expand_semantic_schema(schema: T.StructType, fields: Mapping[str, Mapping]) -> T.StructType:
    """The schema with a ``<field>_semantic_info`` struct for each semantic field: chunks of text and embedding, or one
    embedding, and the model. ``fields``: ``{name: {"model_type": "dense" or "sparse", "chunking": bool, "semantic_info_field_name"?: str}}``."""
    out = list(schema.fields)
    for name, config in fields.items():
        unknown = set(config) - {"model_type", "chunking", "semantic_info_field_name", "dense_embedding_config", "sparse_encoding_config"}
        if unknown:
            raise ValueError(f"unknown settings of semantic field {name}: {sorted(unknown)}")
        kind = config.get("model_type", "dense")
        other = {"dense": "sparse_encoding_config", "sparse": "dense_embedding_config"}.get(kind)
        if other is None:
            raise ValueError(f"unknown model type {kind!r}")
        if other in config:
            raise ValueError(f"{other} does not go with a {kind} model")
        embedding = T.ArrayType(T.FloatType()) if kind == "dense" else T.MapType(T.StringType(), T.DoubleType())
        model = T.StructField("model", T.StructType([T.StructField(x, T.StringType()) for x in ("id", "name", "type")]))
        chunk = T.StructType([T.StructField("text", T.StringType()), T.StructField("embedding", embedding)])
        body = [T.StructField("chunks", T.ArrayType(chunk)), model] if config.get("chunking") else [T.StructField("embedding", embedding), model]
        out.append(T.StructField(config.get("semantic_info_field_name", name + SEMANTIC_SUFFIX), T.StructType(body)))
    return T.StructType(out)


def semantic_ingest(df: DataFrame, field: str, encode: Callable[[Column], Column], chunk: Callable[[Column], Column] | None = None, model: Sequence[str] = ("model", "model", "dense"), doc_id: str = "doc_id") -> DataFrame:
    """Adds ``<field>_semantic_info``: chunks (or the whole text) with embeddings. Each distinct text is encoded once.

    Shuffles chunk texts twice (to make them distinct and to bring embeddings back), never embeddings against documents."""
    pieces = (chunk or (lambda t: F.array(t)))(F.col(field))
    flat = df.select(F.col(doc_id).alias("_id"), F.posexplode(F.filter(pieces, lambda p: F.length(F.trim(p)) > 0)).alias("_i", "text"))
    encoded = flat.select("text").distinct().withColumn("embedding", encode(F.col("text")))
    chunks = flat.join(encoded, "text").groupBy("_id").agg(F.collect_list(F.struct("_i", "text", "embedding")).alias("_all"))
    by_place = F.map_from_entries(F.transform("_all", lambda x: F.struct(x["_i"], F.struct(x["text"].alias("text"), x["embedding"].alias("embedding")))))
    ordered = F.transform(F.array_sort(F.transform("_all", lambda x: x["_i"])), lambda i: F.element_at(F.col("_map"), i))
    info = F.struct(F.lit(model[0]).alias("id"), F.lit(model[1]).alias("name"), F.lit(model[2]).alias("type"))
    chunks = chunks.withColumn("_map", by_place).select("_id", ordered.alias("_chunks"))
    out = df.join(chunks, F.col(doc_id) == F.col("_id"), "left").drop("_id")
    body = F.struct(F.col("_chunks").alias("chunks"), info.alias("model")) if chunk else F.struct(F.element_at("_chunks", 1)["embedding"].alias("embedding"), info.alias("model"))
    return out.withColumn(field + SEMANTIC_SUFFIX, F.when(F.col("_chunks").isNotNull(), body)).drop("_chunks")


def reuse_embeddings(new: DataFrame, old: DataFrame, text: str, embedding: str, encode: Callable[[Column], Column], doc_id: str = "doc_id") -> DataFrame:
    """``new`` with embeddings: those of ``old`` where the same id has the same text, fresh ones for the rest (and ``reused``)."""
    before = old.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t"), F.col(embedding).alias("_e"))
    joined = new.join(before, F.col(doc_id) == F.col("_id"), "left")
    same = F.col("_t").isNotNull() & (F.col("_t") == F.col(text)) & F.col("_e").isNotNull()
    return joined.withColumn("reused", same).withColumn(embedding, F.when(same, F.col("_e")).otherwise(encode(F.when(~same, F.col(text))))).drop("_id", "_t", "_e")
