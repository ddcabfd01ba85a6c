"""Market prices from sold listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loppis.functions import stats
from loppis.session import table

from .base import Book

book = Book()


@book.query("""
WITH v AS (SELECT p_brand, l_extendedprice x FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_returnflag IN ('R', 'A') AND l_extendedprice > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY x) rn, count(*) OVER (PARTITION BY p_brand) n FROM v),
q AS (SELECT p_brand, max(CASE WHEN rn = CAST(floor(n * 0.25) AS BIGINT) + 1 THEN x END) q1,
             max(CASE WHEN rn = CAST(floor(n * 0.75) AS BIGINT) + 1 THEN x END) q3 FROM r GROUP BY p_brand)
SELECT r.p_brand, min(x) AS low, max(x) AS high, CAST(floor(median(x) + 0.5) AS BIGINT) AS median, count(*) AS count
FROM r JOIN q ON r.p_brand = q.p_brand
WHERE n < 4 OR x BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5
GROUP BY r.p_brand HAVING count(*) >= 3""")
def a09_robust_price_range(spark: SparkSession, sf: str) -> DataFrame:
    sold = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).select("l_partkey", "l_extendedprice")
    brands = table(spark, sf, "part").select("p_partkey", "p_brand")
    priced = sold.join(brands, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_extendedprice")
    return stats.robust_range(priced, ["p_brand"], "l_extendedprice")
