"""Ingest jobs of four public logs: parameters around `read_log`."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import SparkSession

from ..model import ObjectLog
from ..operators.transform import from_event_time, upto_event_time, within_event_time
from ..sources.json_docs import read_log
from ..sources.normalize import drop_attributes, normalize

# Roles of the structural columns.
BASE_ROLES = {
    "event": {"event_id": "numerical", "type": "categorical", "time": "timestamp"},
    "object": {"object_id": "numerical", "type": "categorical", "time": "timestamp"},
    "e2o": {"event_id": "numerical", "object_id": "numerical", "qualifier": "categorical", "time": "timestamp"},
    "o2o": {"object_id_src": "numerical", "object_id_dst": "numerical", "qualifier": "categorical", "time": "timestamp"},
}


@dataclass(frozen=True)
class Recipe:
    """Split times, attribute columns to leave out, event times to keep, column roles."""

    val: datetime
    test: datetime
    drop: frozenset[str] = frozenset()
    since: datetime | None = None
    until: datetime | None = None
    roles: dict[str, dict[str, str]] = field(default_factory=dict)

    def all_roles(self) -> dict[str, dict[str, str]]:
        return {**BASE_ROLES, **self.roles}

    def prepare(self, log: ObjectLog) -> ObjectLog:
        if self.since is not None and self.until is not None:
            log = within_event_time(log, self.since, self.until)
        elif self.since is not None:
            log = from_event_time(log, self.since)
        elif self.until is not None:
            log = upto_event_time(log, self.until)
        return normalize(drop_attributes(log, self.drop)) if self.drop else log

    def read(self, spark: SparkSession, path: str) -> ObjectLog:
        return self.prepare(read_log(spark, path))


# The parameters of each log.
RECIPES = {
    "container_logistics": Recipe(
        val=datetime(2024, 4, 1, 6),
        test=datetime(2024, 6, 7, 6),
        drop=frozenset({"Weight"}),
        roles={
            "object_attr_Customer Order": {"object_id": "numerical", "AmountofGoods": "numerical"},
            "object_attr_Vehicle": {"object_id": "numerical", "DepartureDate": "timestamp"},
            "object_attr_Container": {
                "object_id": "numerical", "AmountofHandlingUnits": "numerical", "Status": "categorical", "Weight": "categorical",
            },
            "object_attr_Transport Document": {
                "object_id": "numerical", "AmountofContainers": "numerical", "Status": "categorical",
            },
        },
    ),
    "order_management": Recipe(
        val=datetime(2024, 1, 18, 6),
        test=datetime(2024, 3, 20, 6),
        roles={
            "object_attr_orders": {"object_id": "numerical", "price": "numerical"},
            "object_attr_items": {"object_id": "numerical", "weight": "numerical", "price": "numerical"},
            "object_attr_products": {"object_id": "numerical", "weight": "numerical", "price": "numerical"},
            "object_attr_employees": {"object_id": "numerical", "role": "categorical"},
            "object_attr_packages": {"object_id": "numerical", "weight": "numerical"},
        },
    ),
    "bpi2019": Recipe(
        val=datetime(2018, 9, 20, 6),
        test=datetime(2018, 11, 15, 6),
        drop=frozenset({"ID", "idx", "cID", "cPOID", "cPurDocCat"}),
        since=datetime(2018, 1, 1),
        until=datetime(2019, 1, 30),
        roles={
            "event_attr_*": {
                "event_id": "numerical",
                "eCumNetWorth": "numerical",
                **{
                    column: "categorical"
                    for column in (
                        "cCompany", "cDocType", "cGR", "cGRbasedInvVerif", "cItem", "cItemCat", "cItemType",
                        "cSpendAreaText", "cSpendClassText", "cSubSPendAreaText", "cVendor", "cVendorName", "resource",
                    )
                },
            }
        },
    ),
    "bpi2017": Recipe(
        val=datetime(2016, 9, 28, 6),
        test=datetime(2016, 11, 25, 6),
        drop=frozenset(
            {
                "EventID", "EventIDraw", "case", "idx", "Accepted", "CreditScore", "EventOrigin", "FirstWithdrawalAmount",
                "MonthlyCost", "NumberOfTerms", "OfferID", "OfferedAmount", "Selected",
            }
        ),
        roles={
            "event_attr_*": {
                "event_id": "numerical",
                "RequestedAmount": "numerical",
                **{column: "categorical" for column in ("ApplicationType", "LoanGoal", "Action", "lifecycle", "resource")},
            }
        },
    ),
}
