"""Shares are rounded once."""

from decimal import Decimal

from pyspark.sql import functions as F

from quern.functions import exprs as X


def test_shares_are_rounded_once(spark):
    """0.12449949996 is below the half of a millionth; eight places first would make it 0.12449950."""
    share = lambda x, total: spark.range(1).select(X.share(F.lit(x), F.lit(total)).alias("s")).first().s
    assert share(1_244_999_499_6, 10**11) == Decimal("0.124500") and share(1_244_994_999_6, 10**11) == Decimal("0.124499")
    assert share(1, 2_000_000) == Decimal("0.000001") and share(-1, 3) == Decimal("-0.333333") and share(5, 0) is None
