"""Declared tables: columns, keys, references and lengths.

The lists below are fixed values of the data model. Storage enforces none of
them over Parquet, so operators.quality checks them with Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    table: str
    target: tuple[str, ...]


@dataclass(frozen=True)
class Table:
    """One table: Spark DDL (NOT NULL kept), keys, references, text lengths in bytes or characters."""

    ddl: str
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    in_bytes: bool = True

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.schema.fields if not f.nullable]


FLIGHT_KEY = ("flight_id", "route_code", "departure")

# Name of the year column that prepared datasets are partitioned by.
YEAR_FOLDER = "departure_year"

# Departures outside these years are not accepted.
FIRST_YEAR, LAST_YEAR = 2010, 2026

TABLES = {
    "airplanes": Table(
        ddl="""aircraft_registration string not null, model string not null,
            seats_business smallint, seats_premium smallint, seats_economy smallint,
            crew_members smallint, build_date date not null, fuel_gallons_hour smallint not null,
            maintenance_last_acheck date not null, maintenance_last_bcheck date not null,
            maintenance_takeoffs smallint not null, maintenance_flight_hours int not null,
            total_flight_distance int not null""",
        key=("aircraft_registration",),
        lengths={"aircraft_registration": 7, "model": 25},
    ),
    "airports": Table(
        ddl="""iata_code string not null, airport string not null, city string not null,
            country string not null, continent string not null, timezone string not null,
            latitude double not null, longitude double not null, airport_tax decimal(5,2)""",
        key=("iata_code",),
        lengths={"iata_code": 3, "airport": 50, "city": 20, "country": 20, "continent": 20, "timezone": 6},
    ),
    "flights": Table(
        ddl="""flight_id string not null, flight_leg smallint not null, frequency string not null,
            route_code string not null, departure timestamp_ntz not null, arrival timestamp_ntz not null,
            airplane string not null, price_economy decimal(6,2), price_premium decimal(6,2),
            price_business decimal(6,2)""",
        key=FLIGHT_KEY,
        unique=(("flight_id", "flight_leg", "departure"),),
        references=(
            Reference(("route_code",), "routes", ("route_code",)),
            Reference(("airplane",), "airplanes", ("aircraft_registration",)),
        ),
        lengths={"flight_id": 6, "frequency": 2, "route_code": 4, "airplane": 7},
    ),
    "routes": Table(
        ddl="""route_code string not null, origin string not null, destination string not null,
            parent_route string not null, leg_number smallint not null, distance int,
            flight_minutes smallint""",
        key=("route_code",),
        references=(
            Reference(("origin",), "airports", ("iata_code",)),
            Reference(("destination",), "airports", ("iata_code",)),
            Reference(("parent_route",), "routes", ("route_code",)),
        ),
        lengths={"route_code": 4, "origin": 3, "destination": 3, "parent_route": 6},
    ),
    "flight_crew": Table(
        ddl="""empno int not null, flight_id string not null, route_code string not null,
            departure timestamp_ntz not null""",
        key=("empno", *FLIGHT_KEY),
        references=(Reference(("empno",), "staff", ("empno",)), Reference(FLIGHT_KEY, "flights", FLIGHT_KEY)),
        lengths={"flight_id": 6, "route_code": 4},
        in_bytes=False,
    ),
    "staff": Table(
        ddl="""empno int not null, firstnme string not null, midinit string, lastname string not null,
            gender string, passport string not null, birthdate date not null, hiredate date not null,
            division string not null, department string not null, marital_status string not null,
            phone string, email string""",
        key=("empno",),
        lengths={
            "firstnme": 20, "midinit": 1, "lastname": 20, "gender": 1, "passport": 12, "division": 40,
            "department": 40, "marital_status": 40, "phone": 9, "email": 30,
        },
        in_bytes=False,
    ),
    "tickets": Table(
        ddl="""ticket_id bigint, passenger_id bigint, flight_id string, route_code string,
            departure timestamp_ntz, class string, seat string, price decimal(12,2),
            airport_tax decimal(12,2), local_tax decimal(12,2), total_amount decimal(12,2)""",
        key=("ticket_id",),
        references=(
            Reference(("route_code",), "routes", ("route_code",)),
            Reference(FLIGHT_KEY, "flights", FLIGHT_KEY),
            Reference(("passenger_id",), "passengers", ("id",)),
        ),
    ),
    "passengers": Table(
        ddl="""id bigint, firstnme string, lastname string, gender string, birth_date date,
            country string, vipcard int""",
        key=("id",),
    ),
}


class SchemaError(ValueError):
    """A frame lacks columns that an operator needs."""


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    """The frame itself, or an error that names the missing columns."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SchemaError(f"{what} lacks column(s): {', '.join(missing)}")
    return df


def conform(df: DataFrame, table: str, extra: Sequence[str] = (), absent: Sequence[str] = ()) -> DataFrame:
    """Declared columns in declared types, then the named extra ones as they are.

    A declared column that the frame lacks is an error, unless it is named as
    absent; then it is null. Fixed-width text arrives padded with blanks from some sources, and padded
    keys would not join, so text is right-trimmed. Decimals keep their scale.
    """
    declared = TABLES[table]
    wanted = [f for f in declared.schema.fields if f.name not in absent or f.name in df.columns]
    require_columns(df, [*(f.name for f in wanted), *extra], table)
    columns = [F.col(name) for name in extra]
    for f in reversed(declared.schema.fields):
        if f not in wanted:
            columns.insert(0, F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = F.col(f.name)
        both = (f.dataType, df.schema[f.name].dataType)
        if all(isinstance(t, T.DecimalType) for t in both):
            columns.insert(0, value)
        elif isinstance(f.dataType, T.StringType):
            columns.insert(0, F.rtrim(value.cast("string")).alias(f.name))
        else:
            columns.insert(0, value.cast(f.dataType).alias(f.name))
    return df.select(*columns)
