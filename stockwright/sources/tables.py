"""Table contract, heads, samples, overlays and CSV export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.numeric import sample_key


# --- contract --------------------------------------------------------------------------------------


ANY = object()
#: What each kind of column may say about itself.
FIELD_RULES: dict[str, dict] = {
    "dimension": {"unit": (), "aggregate": ()},
    "time": {"unit": (), "aggregate": ()},
    "measure": {"unit": ANY, "aggregate": ("sum", "mean", "min", "max")},
}


@dataclass(frozen=True)
class Field:
    """A column of a dataset: dimension (text), time (ISO date text) or measure (finite number)."""

    name: str
    kind: str
    unit: str | None = None
    aggregate: str | None = None

    def __post_init__(self) -> None:
        self.metadata()

    def metadata(self) -> dict:
        """What the column's Spark metadata says; a measure without an aggregate is summed."""
        allowed = FIELD_RULES.get(self.kind)
        if allowed is None:
            raise ValueError(f"{self.name} is of kind {self.kind!r}; kinds are {', '.join(FIELD_RULES)}")
        said = {"unit": self.unit, "aggregate": self.aggregate or (allowed["aggregate"] or [None])[0]}
        for key, values in allowed.items():
            if said[key] is not None and values is not ANY and said[key] not in values:
                raise ValueError(f"{self.name}: {key} {said[key]!r} does not go with kind {self.kind}")
        return {"kind": self.kind, **said}


def described(df: DataFrame, fields: list[Field]) -> DataFrame:
    """``df`` in field order with kind, unit and aggregate stored in the column metadata."""
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise ValueError("duplicate field names")
    missing = [n for n in names if n not in df.columns]
    if missing or len(names) != len(df.columns):
        raise ValueError(f"the table has columns {df.columns}, not {names}")
    return df.select(*[F.col(f.name).alias(f.name, metadata=f.metadata()) for f in fields])


ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


def contract_violations(df: DataFrame, fields: list[Field]) -> DataFrame:
    """One row per field: how many values the field cannot hold; text where a number belongs refuses at once."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    counts = []
    for f in fields:
        if f.name not in kinds:
            raise ValueError(f"the table has no column {f.name}")
        col = F.col(f.name)
        if f.kind == "measure":
            if not isinstance(kinds[f.name], T.NumericType):
                raise ValueError(f"field {f.name}: a measure holds a number, got {kinds[f.name].simpleString()}")
            number = col.cast("double")
            bad = F.isnan(number) | (F.abs(number) == float("inf"))
        elif not isinstance(kinds[f.name], T.StringType):
            raise ValueError(f"field {f.name}: a {f.kind} holds text, got {kinds[f.name].simpleString()}")
        elif f.kind == "time":
            bad = ~col.rlike(ISO_DAY) | col.try_cast("date").isNull()
        else:
            bad = F.lit(False)
        counts.append(F.count_if(col.isNotNull() & bad).alias(f.name))
    row = df.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f.name).alias("violations")) for f in fields])
    return row.select(F.explode(pairs).alias("p")).select("p.field", "p.violations")


# --- heads and samples -----------------------------------------------------------------------------


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an order, with the table's row count beside them."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)


def read_at_most(df: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """At most n rows and whether there are more; looks at no more than n + 1 rows."""
    return df.limit(n), df.limit(n + 1).count() > n


def hash_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    """A seeded uniform sample of n rows: the n smallest hashes of the row keys, whatever the partitioning."""
    spread = sample_key(seed, *[F.col(k).cast("string") for k in keys])
    return df.withColumn("_h", spread).orderBy("_h", *keys).limit(n).drop("_h")


# --- overlay ---------------------------------------------------------------------------------------


@dataclass
class Catalog:
    """Named sources by entity and origin; a stream is the overlay of all sources of an entity."""

    sources: dict = field(default_factory=dict)

    def register(self, name: str, entity: str, origin: str, rows: DataFrame, replace: bool = False) -> None:
        held = self.sources if replace else {name: None for name in self.sources}
        if held.setdefault(name, (entity, origin, rows)) is None:
            raise ValueError(f"a source called {name} exists; replace=True puts this one in its place")
        self.sources[name] = (entity, origin, rows)

    def stream(self, entity: str, where: Column | None = None) -> DataFrame:
        """All rows of an entity with their origin; duplicates are kept."""
        out = None
        for kind, origin, rows in self.sources.values():
            if kind == entity:
                part = rows.withColumn("origin", F.lit(origin))
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError(f"no source of {entity}")
        return out if where is None else out.where(where)

    def summary(self) -> DataFrame:
        """Rows by entity and by origin."""
        counts = None
        for entity, origin, rows in self.sources.values():
            one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(entity).alias("entity"), F.lit(origin).alias("origin"), "n")
            counts = one if counts is None else counts.unionByName(one)
        return counts.groupingSets([["entity"], ["origin"]], "entity", "origin").agg(F.sum("n").alias("n")).select(
            F.when(F.col("entity").isNotNull(), "entity").otherwise("origin").alias("kind"),
            F.coalesce("entity", "origin").alias("name"), "n")


# --- CSV export ------------------------------------------------------------------------------------


def csv_safe(df: DataFrame) -> DataFrame:
    """Cells ready for CSV: nested values as JSON, text a spreadsheet would run as a formula quoted."""
    out = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        if isinstance(f.dataType, T.StringType):
            col = F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)
        out.append(col.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a folder of CSV parts with headers."""
    csv_safe(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
