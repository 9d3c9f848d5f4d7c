from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long, inside the engine. Offset basis 2166136261, prime 16777619."""
    data = F.hex(text.cast("binary"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(data)), F.lit(2))
    step = lambda acc, i: F.when(F.length(data) == 0, acc).otherwise(F.pmod(acc.bitwiseXOR(F.conv(F.substr(data, i, F.lit(2)), 16, 10).cast("long")) * 16777619, F.lit(1 << 32)))
    return F.aggregate(at, F.lit(2166136261).cast("long"), step)
