"""Nested records: typed parsing with violations, and flattening into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRING, DOUBLE, BOOLEAN = T.StringType(), T.DoubleType(), T.BooleanType()


def struct(required: dict[str, T.DataType] | None = None, optional: dict[str, T.DataType] | None = None) -> T.StructType:
    """A struct type; required fields are not nullable, and it is this that the checks go by."""
    fields = [T.StructField(n, t, False) for n, t in (required or {}).items()]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in (optional or {}).items()])


_texts = lambda *names: dict.fromkeys(names, STRING)
SPORT = struct({**_texts("key", "group", "title", "description"), "active": BOOLEAN, "has_outrights": BOOLEAN})
EVENT_ID = struct(_texts("id", "sport_key", "sport_title", "commence_time", "home_team", "away_team"))
OUTCOME = struct({"name": STRING, "price": DOUBLE}, {"description": STRING, "point": DOUBLE})
MARKET = struct({**_texts("key", "last_update"), "outcomes": T.ArrayType(OUTCOME)})
BOOKMAKER = struct({**_texts("key", "title"), "markets": T.ArrayType(MARKET)})
EVENT = struct({**_texts("id", "sport_key", "sport_title", "commence_time", "home_team", "away_team"), "bookmakers": T.ArrayType(BOOKMAKER)})
_STAMPS = _texts("timestamp", "previous_timestamp", "next_timestamp")
HISTORICAL_EVENT = struct({**_STAMPS, "data": EVENT})
HISTORICAL_EVENT_IDS = struct({**_STAMPS, "data": T.ArrayType(EVENT_ID)})

#: The payloads of the odds service, by kind; lists of records come one record per row or as arrays.
PAYLOADS = {"sports": SPORT, "event_ids": EVENT_ID, "event": EVENT, "historical_event": HISTORICAL_EVENT, "historical_event_ids": HISTORICAL_EVENT_IDS}


def nullable(kind: T.DataType) -> T.DataType:
    """The type with all fields nullable, as a reader needs it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    return kind


#: What a raw JSON value looks like to be of a type.
_LOOKS = {"string": r'^".*"$', "double": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "bigint": r"^-?\d+$", "int": r"^-?\d+$", "boolean": r"^(true|false)$"}


def _raw(kind: T.DataType) -> T.DataType:
    """The type with every leaf as a variant, which keeps what the JSON held."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _raw(f.dataType), True) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_raw(kind.elementType), True)
    return T.VariantType()


def _violations(raw: Column, kind: T.DataType, path: str) -> Column:
    """An array of what is wrong below ``raw``, a present value."""
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind:
            value, at = raw[f.name], f"{path}.{f.name}" if path else f.name
            lost = value.isNull()
            if not isinstance(f.dataType, T.StructType | T.ArrayType):
                lost = lost | F.is_variant_null(value)
            absent = none if f.nullable else F.array(F.lit(f"missing {at}"))
            parts.append(F.when(lost, absent).otherwise(_violations(value, f.dataType, at)))
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(raw, lambda x: _violations(x, kind.elementType, f"{path}[]")))
    looks = F.to_json(raw).rlike(f"(?s){_LOOKS[kind.simpleString()]}")
    return F.when(looks, none).otherwise(F.array(F.lit(f"wrong type {path}")))


def parsed(df: DataFrame, column: str, kind: T.StructType, to: str = "record", strict: bool = False, defaults: dict[str, Column] | None = None) -> DataFrame:
    """JSON texts as typed records in ``to``, and what is wrong with each in ``violations``.

    Extra fields are ignored, missing or null optional ones are null or their
    default, whole numbers are good doubles. Missing required fields and values
    of a wrong type are violations; ``strict`` makes them errors.
    """
    record = F.from_json(column, nullable(kind))
    if defaults:
        record = F.struct(*[F.coalesce(record[f.name], defaults[f.name]).alias(f.name) if f.name in defaults else record[f.name].alias(f.name) for f in kind])
    raw = F.from_json(column, _raw(kind))
    broken = F.try_parse_json(column).isNull()
    wrong = F.when(broken, F.array(F.lit("no JSON"))).otherwise(F.array_distinct(_violations(raw, kind, "")))
    out = df.withColumn(to, record).withColumn("violations", wrong)
    if strict:
        failed = F.raise_error(F.concat(F.lit("invalid record: "), F.array_join("violations", ", ")))
        out = out.withColumn(to, F.when(F.size("violations") == 0, F.col(to)).otherwise(failed))
    return out




def flattened(df: DataFrame, sep: str = "_", collisions: str = "prefix") -> DataFrame:
    """Structs as columns and arrays of structs as rows, until neither is left.

    Sibling arrays give the product of their rows; an empty or null array gives
    a row with nulls. Arrays of other values stay columns. With ``prefix``
    nested names carry their parents' names; with ``last`` they don't, and of
    equal names the innermost, last one stays.
    """
    if collisions not in ("prefix", "last"):
        raise ValueError("collisions is prefix or last")
    names: dict[str, str] = {c: c for c in df.columns}
    while True:
        nested = next((f for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)), None)
        inline = [f for f in df.schema if isinstance(f.dataType, T.StructType)]
        if inline:
            columns, new = [], {}
            for f in df.schema:
                if f in inline:
                    for g in f.dataType:
                        at = f"{f.name}\x1f{g.name}"
                        columns.append(F.col(f"`{f.name}`")[g.name].alias(at))
                        new[at] = f"{names[f.name]}{sep}{g.name}" if collisions == "prefix" else g.name
                else:
                    columns.append(F.col(f"`{f.name}`"))
                    new[f.name] = names[f.name]
            df, names = df.select(*columns), new
        elif nested:
            others = [F.col(f"`{c}`") for c in df.columns if c != nested.name]
            at = df.columns.index(nested.name)
            df = df.select(*others[:at], F.explode_outer(F.col(f"`{nested.name}`")).alias(nested.name), *others[at:])
        else:
            break
    last = {final: at for at, final in names.items()}
    if collisions == "prefix" and len(last) < len(names):
        raise ValueError("equal names after flattening; choose another sep")
    return df.select(*[F.col(f"`{at}`").alias(final) for at, final in names.items() if last[final] == at])


def merged(base: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Each row with the product of its arrays' elements; an empty array doesn't lose the row."""
    for c in arrays:
        base = base.withColumn(c, F.explode_outer(c))
    return base


def landed(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """Saved responses of one kind as a table: a file each, or a record per line."""
    return spark.read.schema(nullable(PAYLOADS[payload])).option("multiLine", True).json(path)


def odds_table(events: DataFrame) -> DataFrame:
    """Events, one row per outcome, with ``bookmaker_*``, ``market_*`` and ``outcome_*`` columns."""
    books = events.withColumn("bookmaker", F.explode_outer("bookmakers")).drop("bookmakers")
    markets = books.withColumn("market", F.explode_outer("bookmaker.markets"))
    outcomes = markets.withColumn("outcome", F.explode_outer("market.outcomes"))
    keep = [c for c in outcomes.columns if c not in ("bookmaker", "market", "outcome")]
    named = lambda s, kind, drop: [F.col(f"{s}.{f.name}").alias(f"{s}_{f.name}") for f in kind if f.name != drop]
    return outcomes.select(*keep, *named("bookmaker", BOOKMAKER, "markets"), *named("market", MARKET, "outcomes"), *named("outcome", OUTCOME, None))
