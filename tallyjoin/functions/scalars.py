"""Integer scalar functions as Column expressions; all stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit golden-ratio hash factor and the mask of 32 bits.
HASH_FACTOR = 0x9E3779B1
MASK32 = 0xFFFFFFFF
# Above this key the BIGINT product would overflow.
LARGEST_FAST_KEY = (2**63 - 1) // HASH_FACTOR


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def order_value(price: Column | str, quantity: Column | str) -> Column:
    """price * quantity as BIGINT; overflow raises under ANSI mode."""
    return _col(price).cast("bigint") * _col(quantity).cast("bigint")


def order_value_exact(price: Column | str, quantity: Column | str) -> Column:
    """The product over the whole unsigned 32-bit domain, as a decimal."""
    return _col(price).cast("decimal(10,0)") * _col(quantity).cast("decimal(10,0)")


def div_exact(total: Column, count: Column) -> Column:
    """Truncating quotient of a non-negative wide decimal. ``div`` would wrap, ``/`` would round."""
    count = count.cast("decimal(20,0)")
    return F.when(count != 0, ((total - total % count) / F.nullif(count, F.lit(0).cast("decimal(20,0)"))).cast("decimal(20,0)"))


def int_div(total: Column, count: Column) -> Column:
    """Truncating BIGINT division; NULL when there are no rows to divide by."""
    return F.call_function("div", total, F.nullif(count, F.lit(0).cast("bigint")))


def mult_hash(key: Column | str, log_buckets: int) -> Column:
    """Bucket of an unsigned 32-bit key among 2**log_buckets."""
    if not 0 <= log_buckets <= 32:
        raise ValueError("log_buckets must be 0..32")
    key = _col(key)
    fast = (key * F.lit(HASH_FACTOR)).bitwiseAND(F.lit(MASK32))
    wide = ((key.cast("decimal(20,0)") * F.lit(HASH_FACTOR).cast("decimal(10,0)")) % F.lit(2**32).cast("decimal(10,0)")).cast("bigint")
    return F.shiftright(F.when(key <= LARGEST_FAST_KEY, fast).otherwise(wide), 32 - log_buckets)


def lowest_bit(x: Column | str) -> Column:
    return _col(x).bitwiseAND(-_col(x))


def count_trailing_zeros(x: Column | str) -> Column:
    """Zeros below the lowest set bit of a 32-bit value; 32 for 0."""
    return F.when(_col(x) == 0, F.lit(32)).otherwise(F.bit_count(lowest_bit(x) - 1))


def next_pow2(x: Column | str) -> Column:
    """x when it is a power of two, else the next one above."""
    x = _col(x)
    return F.when(x.bitwiseAND(x - 1) == 0, x).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(x))))


def commas(x: Column | str) -> Column:
    return F.format_number(_col(x), 0)


def hash_table_buckets(n: Column | str) -> Column:
    """Smallest power of two that holds n keys at a load of at most 0.67, in integers only."""
    return next_pow2(F.greatest(F.call_function("div", _col(n) * 100 + 66, F.lit(67).cast("bigint")), F.lit(1).cast("bigint")))
