"""Output shaping shared by the registered queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIE_SHIFT = "1e-9"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals."""
    return df.select(
        *[
            F.round(F.col(c) + F.lit(float(TIE_SHIFT)), 6).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
