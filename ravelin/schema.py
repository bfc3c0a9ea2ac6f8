"""The one findings schema, the order key and the severity scale."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def struct_type(fields: str) -> T.StructType:
    """A StructType from 'name type, ...' without needing a session."""
    pairs = (field.split(" ") for field in fields.split(", "))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


FINDING = struct_type(
    "engine string, engine_rank int, pack_rank int, seq bigint, source string, "
    "rule_id string, severity string, title string, message string, "
    "description string, cwe string, category string, chain string, "
    "file string, line int, col int, evidence string, recommendation string, "
    "confidence double, package string, installed_version string, "
    "fixed_in string, cve string, aliases array<string>, refs array<string>, "
    "entropy double, encoding string, var_name string, context_type string, "
    "extra map<string,string>"
)

# What a detection pack returns for one hit.  Everything a rule knows by itself
# (cwe, title, ...) comes later from the rule table; the optional fields here
# override it where the text of the hit decides.
HIT = struct_type(
    "rule_id string, line int, evidence string, seq bigint, severity string, "
    "title string, message string, confidence double, entropy double, "
    "encoding string, var_name string, context_type string"
)

# Engine order, severity order and risk weights.
ENGINES = ["sast", "sca", "secrets", "iac", "web3"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
SEVERITY_ORDINAL = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
RISK_WEIGHT = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3, "INFO": 0}


def hit(**fields: Column) -> Column:
    """A HIT struct with typed nulls for the fields not given."""
    return F.struct(
        *[
            fields[f.name].cast(f.dataType).alias(f.name)
            if f.name in fields
            else F.expr(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}")
            for f in HIT.fields
        ]
    )


def no_hits() -> Column:
    return F.expr(f"CAST(array() AS array<{HIT.simpleString()}>)")


def conform(df: DataFrame) -> DataFrame:
    """Project any frame onto FINDING, adding the columns it lacks as nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in FINDING.fields
        ]
    )


def order_key() -> Column:
    """Total order of findings: engine, pack, file, position inside the file.

    Every "first wins" operator minimises this key, so results do not depend on
    partitioning or arrival order.
    """
    return F.struct("engine_rank", "pack_rank", "file", "seq", "rule_id")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def severity_ordinal(severity: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(SEVERITY_ORDINAL), F.upper(severity)), F.lit(0)
    )


def risk_weight(severity: Column) -> Column:
    return F.coalesce(
        F.try_element_at(literal_map(RISK_WEIGHT), F.upper(severity)), F.lit(0)
    )
