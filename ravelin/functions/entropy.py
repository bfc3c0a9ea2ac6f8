"""Entropy, encoding class, masking and severity of candidate secrets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions.text import contains_any

# Entropy threshold and minimum length per encoding class.
THRESHOLD = {"hex": 3.5, "base64": 4.5, "alphanumeric": 3.8, "url": 3.6, "generic": 4.0}
MIN_LENGTH = {"hex": 16, "base64": 20, "alphanumeric": 20, "url": 24, "generic": 20}

# Names that mark a secret, and the two graver classes of names.
SECRET_NAMES = [
    "key", "secret", "token", "password", "passwd", "pwd", "api_key", "apikey",
    "auth", "credential", "credentials", "access_key", "access_token",
    "refresh_token", "private_key", "secret_key", "client_secret", "signing_key",
    "encryption_key", "auth_token", "bearer", "authorization", "private", "seed",
    "mnemonic", "passphrase", "service_account", "webhook_secret",
]
CRITICAL_NAMES = [
    "private_key", "secret_key", "signing_key", "mnemonic", "seed", "passphrase",
    "password", "passwd", "pwd",
]
HIGH_NAMES = [
    "token", "api_key", "apikey", "auth", "credential", "access_key",
    "access_token", "client_secret",
]


def shannon(value: Column) -> Column:
    """Entropy in bits per character; 0 for an empty text.

    A character is counted by what its removal takes off the length.
    """
    total = F.length(value)
    shares = F.transform(
        F.array_distinct(F.split(value, "")),
        lambda c: (total - F.length(F.replace(value, c, F.lit("")))) / total,
    )
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    )


def encoding_class(value: Column) -> Column:
    """hex, base64, alphanumeric, url or generic, the first that fits."""
    base64 = (
        value.rlike(r"^[A-Za-z0-9+/=]+$")
        & (F.length(value) % 4 == 0)
        & F.try_to_binary(value, F.lit("base64")).isNotNull()
    )
    return (
        F.when(value.rlike(r"^[0-9a-fA-F]+$"), "hex")
        .when(base64, "base64")
        .when(value.rlike(r"^[A-Za-z0-9_\-]+$"), "alphanumeric")
        .when(value.rlike(r"^[A-Za-z0-9%_.~\-]+$"), "url")
        .otherwise("generic")
    )


def by_class(encoding: Column, table: dict) -> Column:
    choice = F
    for name, value in table.items():
        choice = choice.when(encoding == name, F.lit(value))
    return choice


def mask(value: Column) -> Column:
    """First and last four characters around at most 24 stars."""
    n = F.length(value)
    return F.when(n <= 8, F.lit("****")).otherwise(
        F.concat(
            F.substring(value, 1, 4),
            F.repeat(F.lit("*"), F.least(n - 8, F.lit(24))),
            F.right(value, F.lit(4)),
        )
    )


def is_secret_name(name: Column) -> Column:
    """Plain substring test, so 'key' is also found in 'monkey'."""
    return F.exists(F.array(F.lower(name)), lambda low: contains_any(low, SECRET_NAMES))


def secret_severity(entropy: Column, name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(contains_any(low, CRITICAL_NAMES), "CRITICAL")
        .when((entropy >= 5.5) | contains_any(low, HIGH_NAMES), "HIGH")
        .when(entropy >= 4.5, "MEDIUM")
        .otherwise("LOW")
    )
