"""Vector helpers on array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
    )
    return F.sqrt(squares)


def normalize(vector: Column) -> Column:
    """Scale to unit length; a zero vector gives NULL.

    The outer ``transform`` over a one-element array binds the norm, so that it is
    computed once per vector and not once per element.
    """
    scaled = F.transform(
        F.array(norm(vector)),
        lambda n: F.when(
            n > 0, F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))
        ),
    )
    return F.element_at(scaled, 1)
