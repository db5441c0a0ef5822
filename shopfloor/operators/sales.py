"""Open sales value behind the jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators.evidence import Erp
from shopfloor.schemas import JOB
from shopfloor.sources.shared import spread

ORDER = ["Company", "OrderNum"]
LINE = [*ORDER, "OrderLine"]
RELEASE = [*LINE, "OrderRelNum"]


def open_lines(erp: Erp) -> DataFrame:
    """Quantity still to ship and unit price of every order release behind a job.

    The order tables are joined first, from the head down, so that the long list
    of jobs is moved once.
    """
    lines = erp["OrderDtl"].join(spread(erp["OrderHed"], erp["OrderDtl"], *ORDER), ORDER, "left_semi")
    releases = erp["OrderRel"].selectExpr(
        *RELEASE, "OurReqQty - OurJobShippedQty - OurStockShippedQty as Remaining"
    )
    return erp["JobProd"].join(spread(releases, erp["OrderRel"], *LINE).join(lines, LINE), RELEASE)


def open_order_value(erp: Erp) -> DataFrame:
    """Quantity still to ship and its value, per job and unit price."""
    return (
        open_lines(erp)
        .groupBy(*JOB, "UnitPrice")
        .agg(F.sum("Remaining").alias("RemainQty"))
        .selectExpr(*JOB, "UnitPrice", "RemainQty", "RemainQty * UnitPrice as OpenValue")
    )
