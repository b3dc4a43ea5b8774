"""Ingest pipelines by configuration: a list of processors, each with its field map, to one plan over a table of documents.

A field map goes from a source field to a target beside it; maps inside it follow nested fields, and dotted names are such maps.
``{"processors": [{"text_chunking": {...}}, {"text_embedding": {...}}, {"sparse_encoding": {...}}, {"text_image_embedding": {...}}]}``"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.functions import sparse, text
from ranksmith.operators import ingest
from ranksmith.operators.models import ModelRegistry

DEFAULT_ALGORITHM = "fixed_token_length"
#: Settings that every processor may have besides its own.
COMMON = {"description", "tag", "ignore_failure"}
SETTINGS = {
    "text_chunking": {"algorithm", "field_map", "ignore_missing"},
    "text_embedding": {"model_id", "field_map", "batch_size", "skip_existing"},
    "sparse_encoding": {"model_id", "field_map", "batch_size", "skip_existing", "prune_type", "prune_ratio"},
    "text_image_embedding": {"model_id", "embedding", "field_map", "skip_existing"},
}
#: What makes a target of a source field, given its type and where it is.
Maker = Callable[[Column, T.DataType, str], Column]


def _is_text_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)


def _within(value: Column, kind: T.StructType, fields: Mapping, make: Maker, ignore_missing: bool, path: str) -> Column:
    """A struct with the targets of its fields."""
    for source, target in fields.items():
        where = f"{path}.{source}"
        if source not in kind.names:
            if ignore_missing:
                continue
            raise ValueError(f"there is no field {where}")
        value = value.withField(*_target(value.getField(source), kind[source].dataType, source, target, make, ignore_missing, where))
    return value


def _target(child: Column, kind: T.DataType, source: str, target, make: Maker, ignore_missing: bool, where: str) -> tuple[str, Column]:
    """The name and value of the field that a map entry sets."""
    if not isinstance(target, Mapping):
        return str(target), make(child, kind, where)
    if isinstance(kind, T.StructType):
        return source, F.when(child.isNotNull(), _within(child, kind, target, make, ignore_missing, where))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return source, F.transform(child, lambda x: F.when(x.isNotNull(), _within(x, kind.elementType, target, make, ignore_missing, f"{where}[]")))
    raise ValueError(f"{where} holds no fields")


def map_fields(df: DataFrame, field_map: Mapping, make: Maker, ignore_missing: bool = False) -> DataFrame:
    """``df`` with the target of each entry of a field map."""
    for source, target in ingest.unflatten(field_map).items():
        if source not in df.columns:
            if ignore_missing:
                continue
            raise ValueError(f"there is no field {source}")
        df = df.withColumn(*_target(F.col(f"`{source}`"), df.schema[source].dataType, source, target, make, ignore_missing, source))
    return df


def chunking(settings: Mapping) -> Maker:
    """Chunks of a text, or of all texts of a list in one flat list whose limit they share."""
    algorithms = settings.get("algorithm") or {DEFAULT_ALGORITHM: {}}
    if len(algorithms) != 1:
        raise ValueError("a chunking processor has exactly one algorithm")
    (name, own), *_ = algorithms.items()
    own = {"max_chunk_limit": text.DEFAULT_CHUNK_LIMIT, **own}
    chunk = text.chunker(name, **own)

    def make(value: Column, kind: T.DataType, where: str) -> Column:
        if isinstance(kind, T.StringType):
            return chunk(value)
        if _is_text_list(kind):
            return text.chunk_texts(value, name, **own)
        raise ValueError(f"{where} is neither a text nor a list of texts")

    return make


def embedding(registry: ModelRegistry, settings: Mapping) -> Maker:
    """A vector of a text, or ``{knn: vector}`` for each text of a list."""
    model, size = settings["model_id"], settings.get("batch_size")

    def make(value: Column, kind: T.DataType, where: str) -> Column:
        if "[]" in where:
            raise ValueError(f"{where}: texts inside a list of objects cannot be embedded")
        if isinstance(kind, T.StringType):
            return registry.column(model, ingest.blank_to_null(value), batch_size=size)
        if _is_text_list(kind):
            return F.transform(registry.list_column(model, value, batch_size=size), lambda v: F.struct(v.alias("knn")))
        raise ValueError(f"{where} is neither a text nor a list of texts")

    return make


def encoding(registry: ModelRegistry, settings: Mapping) -> Maker:
    """Token weights of a text, pruned."""
    prune, ratio = settings.get("prune_type", "none"), settings.get("prune_ratio")
    sparse.check_prune(prune, ratio)
    inner = embedding(registry, settings)

    def make(value: Column, kind: T.DataType, where: str) -> Column:
        if not isinstance(kind, T.StringType):
            raise ValueError(f"{where} is no text")
        return sparse.prune(inner(value, kind, where), prune, ratio)

    return make


def run(df: DataFrame, pipeline: Mapping, registry: ModelRegistry | None = None) -> DataFrame:
    """``df`` after the pipeline's processors, in order."""
    registry = registry or ModelRegistry()
    for processor in pipeline.get("processors", []):
        if len(processor) != 1:
            raise ValueError("a processor is a map with one name")
        (name, settings), *_ = processor.items()
        if name not in SETTINGS:
            raise ValueError(f"unknown ingest processor {name!r}; known: {', '.join(SETTINGS)}")
        if unknown := set(settings) - SETTINGS[name] - COMMON:
            raise ValueError(f"unknown settings of {name}: {sorted(unknown)}")
        if not settings.get("field_map"):
            raise ValueError(f"{name} needs a field_map")
        if name == "text_image_embedding":
            fields = settings["field_map"]
            if set(fields) - {"text", "image"} or not settings.get("embedding"):
                raise ValueError("text_image_embedding maps text and image to an embedding")
            df = ingest.image_embedding(df, registry, settings["model_id"], settings["embedding"], fields.get("text"), fields.get("image"))
            continue
        make = {"text_chunking": lambda s: chunking(s), "text_embedding": lambda s: embedding(registry, s), "sparse_encoding": lambda s: encoding(registry, s)}[name](settings)
        df = map_fields(df, settings["field_map"], make, settings.get("ignore_missing", name != "text_chunking"))
    return df


def reindex(df: DataFrame, old: DataFrame, pipeline: Mapping, registry: ModelRegistry, doc_id: str = "doc_id") -> DataFrame:
    """``run`` over what is new or changed. Processors with ``skip_existing`` take over the targets of documents in ``old`` whose
    source texts are all the same; the join is by id, and only the other documents reach a model."""
    fields: dict[str, str] = {}
    for processor in pipeline.get("processors", []):
        (name, settings), *_ = processor.items()
        if not settings.get("skip_existing"):
            return run(df, pipeline, registry)
        own = settings["field_map"]
        if any(isinstance(x, Mapping) or "." in k for k, x in own.items()):
            raise ValueError("skip_existing goes with top-level fields")
        fields |= {x: settings["embedding"] for x in own.values()} if name == "text_image_embedding" else dict(own)
    targets = list(dict.fromkeys(fields.values()))
    before = old.select(F.col(doc_id).alias("_id"), F.struct(*[F.col(c) for c in fields]).alias("_was"), F.struct(*[F.col(c) for c in targets]).alias("_have"))
    joined = df.join(before, F.col(doc_id) == F.col("_id"), "left")
    same = F.col("_id").isNotNull() & F.struct(*[F.col(c) for c in fields]).eqNullSafe(F.col("_was"))
    for c in targets:
        same = same & F.col("_have")[c].isNotNull()
    marked = joined.withColumn("_same", same)
    kept = marked.filter("_same").select(*df.columns, *[F.col("_have")[c].alias(c) for c in targets])
    fresh = run(marked.filter("not _same").select(*df.columns), pipeline, registry)
    return kept.unionByName(fresh.select(*kept.columns))
