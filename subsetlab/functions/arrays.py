"""Column expressions on numeric arrays. Everything stays inside the JVM; no row ever leaves Spark."""
from pyspark.sql import Column, functions as F


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    """Mean of a non-empty array of doubles, null for an empty one."""
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays of the same length."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of the same length."""
    return F.sqrt(squared_distance(a, b))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when one of the vectors is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def add(a: Column, b: Column) -> Column:
    """Element-wise sum."""
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, factor: Column) -> Column:
    """Element-wise product with a scalar column."""
    return F.transform(a, lambda x: x * factor)


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of a short array of vectors (one per run or per window); null when the array is empty."""
    first = F.get(vectors, F.lit(0))
    summed = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), first, add)
    return F.when(F.size(vectors) > 0, scale(summed, F.lit(1.0) / F.size(vectors)))


def quantile_sorted(ordered: Column, share: float) -> Column:
    """Linearly interpolated quantile of an array that is already in ascending order."""
    place = (F.size(ordered) - 1) * F.lit(float(share))
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(ordered) - 1)
    bottom, top = F.get(ordered, low), F.get(ordered, high)
    return bottom + (place - low) * (top - bottom)


def quantile(values: Column, share: float) -> Column:
    """Linearly interpolated quantile of a short array."""
    return quantile_sorted(F.array_sort(values), share)


def clean(value: Column, digits: int = 6) -> Column:
    """Value at the output boundary: rounded, without negative zero."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)
