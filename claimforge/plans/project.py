"""A configuration compiled to columns: paths, re-normalization, missing values, metadata and violations.

The profile's schema is fixed, so whether a path can be found, and the type it has, is known when the plan is
made; only nulls and array bounds are left to the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimforge.functions.normalize import REGISTRY, good, normalizer_name
from claimforge.plans.config import Config, FieldSpec, OnMissing, parse_path, root_field

VIOLATION = "struct<path:string,reason:string,detail:string>"


@dataclass(frozen=True)
class Resolved:
    """A path's column (null where it leads nowhere) and type; no type when no row can have it."""

    value: Column
    type: T.DataType | None


def _member(name: str):
    return lambda x: x[name]


def resolve(schema: T.StructType, path: str) -> Resolved:
    """Follow ``path`` from the root of ``schema``."""
    nothing = Resolved(F.lit(None).cast("string"), None)
    here: Column | None = None
    kind: T.DataType = schema
    mapping = False
    for s in parse_path(path):
        inner = kind.elementType if mapping and isinstance(kind, T.ArrayType) else kind
        if not isinstance(inner, T.StructType) or s.name not in inner.names:
            return nothing
        member = inner[s.name].dataType
        if mapping:
            here, kind = F.transform(here, _member(s.name)), T.ArrayType(member)
        else:
            here, kind = F.col(f"`{s.name}`") if here is None else here[s.name], member
        if s.index is not None:
            if mapping or not isinstance(kind, T.ArrayType):
                return nothing
            here, kind = F.get(here, F.lit(s.index)), kind.elementType
        elif s.each:
            if not isinstance(kind, T.ArrayType):
                return nothing
            mapping = True
    return Resolved(here, kind)


def renormalized(r: Resolved, token: str) -> Resolved:
    """``r`` through a registered normalizer: strings as they are, items of a list one by one, failures dropped."""
    which = normalizer_name(token)
    if which not in REGISTRY or r.type is None:
        return r
    apply = REGISTRY[which]
    kind = T.DoubleType() if which == "years_experience" else T.StringType()
    if isinstance(r.type, T.StringType):
        return Resolved(good(apply(r.value)), kind)
    if isinstance(r.type, T.ArrayType) and isinstance(r.type.elementType, T.StringType):
        done = F.transform(r.value, apply)
        # Items that aren't strings (nulls) pass; strings that fail go.
        pairs = F.arrays_zip(r.value.alias("raw"), done.alias("done"))
        kept = F.filter(pairs, lambda p: p["raw"].isNull() | (p["done"]["ok"] & p["done"]["value"].isNotNull()))
        return Resolved(F.when(r.value.isNotNull(), F.transform(kept, lambda p: p["done"]["value"])), T.ArrayType(kind))
    return r


def type_ok(kind: T.DataType | None, token: str) -> bool:
    """Whether values of ``kind`` are what a type token asks; unknown tokens ask nothing."""
    token = token.strip().lower()
    if kind is None:
        return True
    if token == "string":
        return isinstance(kind, T.StringType)
    if token in ("string[]", "array", "list"):
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)
    if token in ("number", "float"):
        return isinstance(kind, T.NumericType)
    if token in ("integer", "int"):
        return isinstance(kind, T.IntegralType)
    if token == "boolean":
        return isinstance(kind, T.BooleanType)
    if token == "object":
        return isinstance(kind, T.StructType)
    return True


def _violation(path: str, reason: str, detail: str | None) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason"), F.lit(detail).cast("string").alias("detail"))


@dataclass(frozen=True)
class Compiled:
    """One field: its value, whether it is placed in the output, and what is wrong with it (or null)."""

    spec: FieldSpec
    value: Column
    type: T.DataType | None
    placed: Column
    violation: Column


def compile_field(schema: T.StructType, spec: FieldSpec, config: Config) -> Compiled:
    found = resolve(schema, spec.origin)
    missing = found.value.isNull()
    out = renormalized(found, spec.normalize) if spec.normalize is not None else found
    failed = ~missing & out.value.isNull()
    none = F.lit(None).cast(VIOLATION)
    if spec.required:
        placed = ~missing & ~failed
        wrong = F.when(missing, _violation(spec.path, "missing_required", spec.origin)).when(failed, _violation(spec.path, "normalize_failed", spec.normalize)).otherwise(none)
    elif config.on_missing is OnMissing.OMIT:
        placed, wrong = ~missing, none
    elif config.on_missing is OnMissing.ERROR:
        placed, wrong = ~missing, F.when(missing, _violation(spec.path, "missing", spec.origin)).otherwise(none)
    else:
        placed, wrong = F.lit(True), none
    return Compiled(spec, out.value, out.type, placed, wrong)


def validated(spec: FieldSpec, same_path: list[Compiled]) -> Column:
    """The schema violation of a field, or null, judged on what the view holds at its path: the value placed there last."""
    none = F.lit(None).cast(VIOLATION)
    absent = _violation(spec.path, "missing_required", None) if spec.required else none
    out = absent
    for c in same_path:
        held = none if type_ok(c.type, spec.type) else _violation(spec.path, "type_mismatch", spec.type)
        out = F.when(c.placed, F.when(c.value.isNull(), absent).otherwise(held)).otherwise(out)
    return out


def project(profiles: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``keep`` columns, values, meta, violations): the view of every profile as JSON objects, and its report.

    ``values`` and ``meta`` are VARIANT objects keyed by output path; an omitted field has no key, an empty one a null.
    Of specs with the same path the last placed wins. The violations of projection come before those of
    the schema. No fields: the whole profile, without metadata.
    """
    schema = T.StructType([f for f in profiles.schema.fields if f.name != "cluster_id"])
    empty = F.array().cast(f"array<{VIOLATION}>")
    if not config.fields:
        whole = F.to_variant_object(F.struct(*(F.col(f.name) for f in schema.fields)))
        return profiles.select(*keep, whole.alias("values"), F.parse_json(F.lit("{}")).alias("meta"), empty.alias("violations"))
    fields = [compile_field(schema, s, config) for s in config.fields]
    last = {c.spec.path: c for c in fields}
    toggled = config.include_confidence or config.include_provenance

    def variant(c: Compiled) -> Column:
        if isinstance(c.type, (T.StructType, T.ArrayType)):
            return F.to_variant_object(c.value)
        return c.value.cast("variant")

    def meta(c: Compiled) -> Column:
        root = root_field(c.spec.origin)
        sidecar = []
        if config.include_confidence:
            sidecar.append(F.col("overall_confidence").alias("confidence"))
        if config.include_provenance:
            sidecar.append(F.filter("provenance", lambda p: p["field"] == root).alias("provenance"))
        return F.to_variant_object(F.struct(*sidecar))

    def keyed(make) -> Column:
        placed = [(path, [c for c in fields if c.spec.path == path]) for path in last]
        entry = [F.when(_any(c.placed for c in cs), F.struct(F.lit(path).alias("k"), F.coalesce(*(F.when(c.placed, F.struct(make(c).alias("v"))) for c in reversed(cs)))["v"].alias("v"))) for path, cs in placed]
        return F.to_variant_object(F.map_from_entries(F.array_compact(F.array(*entry))))

    shared = {path: [c for c in fields if c.spec.path == path] for path in last}
    wrong = F.array_compact(F.array(*(c.violation for c in fields), *(validated(c.spec, shared[c.spec.path]) for c in fields)))
    return profiles.select(*keep, keyed(variant).alias("values"), (keyed(meta) if toggled else F.parse_json(F.lit("{}"))).alias("meta"), wrong.alias("violations"))


def _any(flags) -> Column:
    out = F.lit(False)
    for x in flags:
        out = out | x
    return out


def project_columns(profiles: DataFrame, config: Config, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same view with one typed column per path, for use inside Spark; omitted and empty are both null."""
    fields = {s.path: compile_field(profiles.schema, s, config) for s in config.fields}
    return profiles.select(*keep, *(F.when(c.placed, c.value).alias(path) for path, c in fields.items()))
