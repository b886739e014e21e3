"""Database type names and the Spark types they are stored as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which database type names are stored as which Spark type. `time`
# values are kept as text because the session default rejects Spark's TIME type.
POSTGRESQL_TYPES = {
    "smallint": ["smallint", "int2"],
    "int": ["integer", "int", "int4", "serial"],
    "bigint": ["bigint", "int8", "bigserial"],
    "float": ["real", "float4"],
    "double": ["double precision", "float8", "float", "numeric", "decimal", "money"],
    "boolean": ["boolean", "bool"],
    "date": ["date"],
    "time_text": ["time", "time without time zone", "time with time zone"],
    "timestamp_ntz": ["timestamp", "timestamp without time zone"],
    "timestamp": ["timestamp with time zone", "timestamptz"],
    "binary": ["bytea"],
    "string": [
        "interval", "character varying", "varchar", "character", "char", "text", "name",
        "json", "jsonb", "inet", "cidr", "macaddr", "macaddr8", "uuid", "array",
        "point", "line", "lseg", "box", "path", "polygon", "circle",
        "int4range", "int8range", "numrange", "tsrange", "tstzrange", "daterange",
    ],
}
GREENPLUM_EXTRA_TYPES = {"int": ["gp_segment_id"]}
VERTICA_TYPES = {
    "tinyint": ["tinyint"],
    "smallint": ["smallint"],
    "bigint": ["int", "integer", "bigint", "auto_increment"],
    "float": ["real"],
    "double": ["float", "float8", "double precision", "numeric", "decimal", "money"],
    "boolean": ["boolean", "bool"],
    "date": ["date"],
    "time_text": ["time", "time with time zone"],
    "timestamp_ntz": ["timestamp"],
    "timestamp": ["timestamp with time zone", "timestamptz"],
    "binary": ["binary", "varbinary", "long varbinary", "bytea"],
    "string": [
        "interval", "varchar", "char", "long varchar", "text", "uuid",
    ],
}
STRING_FALLBACK_TYPES = [
    "json", "jsonb", "xml", "inet", "cidr", "macaddr", "uuid", "point", "line", "polygon",
    "circle", "path", "box", "interval", "tsrange", "daterange",
]
FLOAT_FALLBACK_TYPES = ["numeric", "decimal", "money"]
PROBLEMATIC_TYPES = ["text", "varchar", "char", "json", "jsonb", "uuid"]
# End of fixed values. The many `interval x to y` names of Vertica need no entries:
# the longest matching word prefix is `interval`.

# No listed name has more words, so longer prefixes need not be looked at.
MAX_TYPE_WORDS = max(
    len(name.split())
    for group in (POSTGRESQL_TYPES, GREENPLUM_EXTRA_TYPES, VERTICA_TYPES)
    for names in group.values()
    for name in names
)


def type_names(dialect: str = "postgresql") -> dict[str, str]:
    """Database type name -> Spark type name. Unknown dialects read as PostgreSQL."""
    dialect = dialect.lower()
    groups = [VERTICA_TYPES] if dialect == "vertica" else [POSTGRESQL_TYPES]
    if dialect == "greenplum":
        groups.append(GREENPLUM_EXTRA_TYPES)
    return {name: spark for group in groups for spark, names in group.items() for name in names}


def normalized_type(data_type: Column) -> Column:
    """Lower case, without parameters such as ``(10,2)``, single-spaced."""
    bare = F.regexp_replace(F.lower(data_type), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def spark_type(data_type: Column, dialect: str = "postgresql") -> Column:
    """Spark type name of a database type name.

    An exact name wins, then the longest prefix that ends at a word boundary; an array
    or unknown type is text. A pure projection: no join, no shuffle.
    """
    pairs = ", ".join(f"'{name}', '{spark}'" for name, spark in type_names(dialect).items())
    lookup = F.expr(f"map({pairs})")
    base = normalized_type(data_type)
    prefixes = [F.substring_index(base, " ", n) for n in range(MAX_TYPE_WORDS, 0, -1)]
    known = F.coalesce(*[F.try_element_at(lookup, p) for p in prefixes], F.lit("string"))
    return F.when(base.endswith("[]") | base.startswith("array"), F.lit("string")).otherwise(known)


def storage_type(spark_name: str) -> str:
    """DDL type for a name returned by :func:`spark_type`."""
    return "string" if spark_name == "time_text" else spark_name


def override_hint(data_type: Column) -> Column:
    """Which cast needs care: text for exotic types, double for exact numbers."""
    base = normalized_type(data_type)
    return (
        F.when(base.isin(STRING_FALLBACK_TYPES), "string_fallback")
        .when(base.isin(FLOAT_FALLBACK_TYPES), "float64_fallback")
        .otherwise("none")
    )


def is_problematic(data_type: Column) -> Column:
    return normalized_type(data_type).isin(PROBLEMATIC_TYPES)
