"""Decision rules as Column expressions.

Each rule maps aggregates of provenance to a band.  The inputs are counts of
distinct *publishers*, never counts of rows, so no number of rows or documents
from one publisher can raise a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from corrobora import vocab


def _lookup(values: dict, key: Column, default) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def evidence_class(best_tier: Column, publishers: Column) -> Column:
    """A for a tier-1 publisher, B for two or more publishers, else C."""
    return (F.when(best_tier == 1, "A")
            .when(publishers >= 2, "B")
            .otherwise("C"))


def evidence_confidence(best_tier: Column, publishers: Column) -> Column:
    """HIGH / MEDIUM_HIGH with the class; inside class C, MEDIUM up to tier 3."""
    return (F.when(best_tier == 1, "HIGH")
            .when(publishers >= 2, "MEDIUM_HIGH")
            .when(best_tier <= 3, "MEDIUM")
            .otherwise("LOW"))


def signal_strength(publishers: Column, best_tier: Column) -> Column:
    """Corroboration band of a signal."""
    return (F.when(publishers >= 3, "STRONG")
            .when((publishers == 2) & (best_tier == 1), "STRONG_EMERGING")
            .when(publishers == 2, "EMERGING")
            .otherwise("WEAK"))


def forced_direction(publishers: Column, best_tier: Column) -> Column:
    """UNCERTAIN when a lone tier-4 publisher carries the signal, else null."""
    return F.when((F.coalesce(publishers, F.lit(0)) <= 1) & (best_tier >= 4), "UNCERTAIN")


def gate_satisfied(rows: Column, publishers: Column) -> Column:
    """A national conclusion needs enough A/B rows from enough publishers."""
    return (rows >= vocab.GATE_MIN_ROWS) & (publishers >= vocab.GATE_MIN_PUBLISHERS)


def gate_state(satisfied: Column, existing: Column) -> Column:
    """Status after this run.

    An unsatisfied gate is (re)opened; a satisfied one passes only if it was
    open; a gate that never existed and is satisfied yields no row (null).
    """
    return (F.when(~satisfied, "OPEN")
            .when(existing == "OPEN", "PASSED")
            .otherwise(existing))


def three_band(n: Column, two: int, three: int) -> Column:
    """3 from ``three`` upwards, 2 from ``two`` upwards, else 1."""
    return F.when(n >= three, 3).when(n >= two, 2).otherwise(1)


def likelihood(strong_rows: Column) -> Column:
    """Risk likelihood (opportunity attractiveness): A/B rows behind it."""
    return three_band(strong_rows, 1, 2)


def impact(topics: Column) -> Column:
    """Risk impact (opportunity feasibility): distinct topics touched."""
    return three_band(topics, 2, 3)


def cross_impact_severity(a_strength: Column, b_strength: Column) -> Column:
    """Half the summed strength ranks, clamped to 1..3."""
    total = (_lookup(vocab.SEVERITY_RANK, F.coalesce(a_strength, F.lit("WEAK")), 1)
             + _lookup(vocab.SEVERITY_RANK, F.coalesce(b_strength, F.lit("WEAK")), 1))
    return F.greatest(F.lit(1), F.least(F.lit(3), F.floor(total / 2).cast("int")))


def strength_rank(strength: Column) -> Column:
    return _lookup(vocab.STRENGTH_RANK, strength, 0)


def strength_points(strength: Column) -> Column:
    return _lookup(vocab.STRENGTH_POINTS, F.coalesce(strength, F.lit("WEAK")), 0)


def horizon_penalty(horizon: Column) -> Column:
    return _lookup(vocab.HORIZON_PENALTY, F.coalesce(horizon, F.lit("")), -2)


def calibrate(base_points: Column, publishers: Column, horizon: Column,
              uncertainties: Column) -> Column:
    """Forecast band, confidence and the points they come from, as one struct."""
    base = F.coalesce(base_points, F.lit(0))
    pubs = F.coalesce(publishers, F.lit(0))
    pub_points = F.when(pubs >= 3, 2).when(pubs == 2, 1).otherwise(0)
    penalty = horizon_penalty(horizon)
    unc_points = -F.least(F.coalesce(uncertainties, F.lit(0)), F.lit(2))
    score = base + pub_points + penalty + unc_points
    band = (F.when(score >= 4, "LIKELY").when(score >= 2, "POSSIBLE")
            .when(score >= 1, "UNCERTAIN").otherwise("SPECULATIVE"))
    confidence = (F.when((score >= 4) & (pubs >= 3) & (base >= 3), "HIGH")
                  .when(score >= 4, "MEDIUM_HIGH").when(score >= 2, "MEDIUM").otherwise("LOW"))
    return F.struct(
        band.alias("plausibility"), confidence.alias("confidence"),
        base.cast("int").alias("signal_points"), pub_points.alias("publisher_points"),
        penalty.cast("int").alias("horizon_penalty"),
        unc_points.cast("int").alias("uncertainty_penalty"), score.cast("int").alias("score"))


def readiness(evidence: Column, publishers: Column, live_signals: Column) -> Column:
    """Empty / Ready / Thin verdict of a branch or topic."""
    return (F.when(F.coalesce(evidence, F.lit(0)) == 0, "Empty")
            .when((publishers >= vocab.READY_PUBLISHERS) & (live_signals >= 1), "Ready")
            .otherwise("Thin"))


def label(value: Column) -> Column:
    """Display form of an enum value; anything else passes through."""
    pairs = [F.lit(x) for kv in vocab.LABELS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value)


def relabelled(value: Column, kind: DataType, fields: frozenset = vocab.ENUM_FIELDS) -> Column:
    """``value`` with every enum field inside it in its display form, however deep.

    Walks the type: structs, arrays and maps with text keys.  A field named in
    ``fields`` is relabelled if it is a text or a list of texts, else walked on; parts without
    such fields stay as they are.
    """
    if not _names_enum(kind, fields):
        return value
    if isinstance(kind, StructType):
        parts = [_field(value.getField(f.name), f.name, f.dataType, fields).alias(f.name)
                 for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: relabelled(x, kind.elementType, fields))
    inner = kind.valueType
    named = lambda k: k.isin(*sorted(fields))
    if isinstance(inner, StringType):
        return F.transform_values(value, lambda k, v: F.when(named(k), label(v)).otherwise(v))
    if isinstance(inner, ArrayType) and isinstance(inner.elementType, StringType):
        return F.transform_values(value, lambda k, v: F.when(named(k), F.transform(v, label)).otherwise(v))
    return F.transform_values(value, lambda k, v: relabelled(v, inner, fields))


def _field(value: Column, name: str, kind: DataType, fields: frozenset) -> Column:
    if name in fields and isinstance(kind, StringType):
        return label(value)
    if name in fields and isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
        return F.transform(value, label)
    return relabelled(value, kind, fields)


def _names_enum(kind: DataType, fields: frozenset) -> bool:
    """Whether a type holds a field that may be relabelled; any map with text keys might."""
    if isinstance(kind, StructType):
        return any(f.name in fields or _names_enum(f.dataType, fields) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _names_enum(kind.elementType, fields)
    if isinstance(kind, MapType):
        texts = isinstance(kind.valueType, StringType) or isinstance(kind.valueType, ArrayType) and isinstance(kind.valueType.elementType, StringType)
        return isinstance(kind.keyType, StringType) and (texts or _names_enum(kind.valueType, fields)) or _names_enum(kind.valueType, fields)
    return False


def humanised(df: DataFrame, fields: frozenset = vocab.ENUM_FIELDS) -> DataFrame:
    """``df`` with every enum field, in whatever column and depth, in its display form."""
    return df.select(*[_field(F.col(f"`{f.name}`"), f.name, f.dataType, fields).alias(f.name) for f in df.schema.fields])


def clamp_direction(direction: Column) -> Column:
    """Directions outside the domain become UNCERTAIN."""
    return F.when(direction.isin(*vocab.DIRECTIONS), direction).otherwise("UNCERTAIN")


def ratio(part: Column, whole: Column, scale: int) -> Column:
    """``part * scale / whole`` rounded half-to-even on the exact quotient, as a long.

    Integer arithmetic only, so the last digit never depends on a float; a zero
    denominator gives 0.
    """
    whole = whole.cast("long")
    top = part.cast("long") * F.lit(scale)
    safe = F.when(whole == 0, F.lit(1)).otherwise(whole)
    rest = top % safe
    quot = F.call_function("div", top, safe)
    bump = (rest * 2 > safe) | ((rest * 2 == safe) & (quot % 2 == 1))
    return F.when(whole == 0, F.lit(0)).otherwise(quot + F.when(bump, 1).otherwise(0)).cast("long")
