"""One-way hashing of secret credentials: ``salt$sha256(salt + secret)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the longest secret that is accepted, in bytes.
MAX_SECRET_BYTES = 71


def hash_secret(secret: Column, salt: Column | None = None) -> Column:
    """Salted hash; a random salt per row by default (write the result once before reusing it)."""
    if salt is None:
        salt = F.regexp_replace(F.expr("uuid()"), "-", "")
    # One struct, so that salt and hash see the same random value.
    s = F.transform(F.array(salt), lambda x: F.concat(x, F.lit("$"), F.sha2(F.concat(x, secret), 256)))
    return F.when(secret.isNotNull(), s[0])


def verify_secret(secret: Column, stored: Column) -> Column:
    """Does the secret belong to the stored hash? Never null."""
    salt = F.substring_index(stored, "$", 1)
    same = F.concat(salt, F.lit("$"), F.sha2(F.concat(salt, secret), 256)) == stored
    return F.coalesce(same, F.lit(False))


def too_long(secret: Column) -> Column:
    return F.octet_length(secret) > MAX_SECRET_BYTES
