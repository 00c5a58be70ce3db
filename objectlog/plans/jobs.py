"""Named label jobs: a builder with its parameters, bound to a kind of log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from ..grid import Grid
from ..model import OBJECT, ObjectLog, TableMeta
from ..operators import baselines, labels, observe
from ..operators.observe import PAIR, SINGLE

_TASK_TYPES = {
    "next_event": "multiclass",
    "attribute_class": "multiclass",
    "event_count": "regression",
    "related_count": "regression",
    "attribute_value": "regression",
    "pair_count": "regression",
    "time_to_event": "regression",
    "pair_within": "binary",
    "transition": "binary",
}


@dataclass(frozen=True)
class LabelJob:
    """One prediction target. `delta` is the horizon and the step of the grid."""

    log: str
    name: str
    kind: str
    object_types: tuple[str, ...]
    source: str
    delta: timedelta
    target: str | None = None
    classes: tuple[str, ...] = ()
    max_age: timedelta | None = None
    table: str | None = None
    column: str | None = None
    num_eval: int = 1000

    @property
    def task_type(self) -> str:
        return _TASK_TYPES[self.kind]

    @property
    def keys(self) -> tuple[str, ...]:
        return PAIR if self.kind.startswith("pair") else SINGLE

    @property
    def meta(self) -> TableMeta:
        """Label tables have no primary key; every entity column refers to objects."""
        return TableMeta(pk=None, fks={key: OBJECT for key in self.keys})

    def build(self, log: ObjectLog, grid: Grid) -> DataFrame:
        own, age = self.object_types[0], self.max_age
        if self.kind == "next_event":
            return labels.stage_next_event(log, own, grid, self.delta, self.source, self.classes, age)
        if self.kind == "transition":
            return labels.stage_transition(log, own, grid, self.delta, self.source, self.target, age)
        if self.kind == "event_count":
            return labels.stage_event_count(log, own, grid, self.delta, self.source, self.target, age)
        if self.kind == "related_count":
            related = self.object_types[1]
            return labels.stage_related_count(log, own, related, grid, self.delta, self.source, self.target, age)
        if self.kind == "attribute_value":
            return labels.stage_attribute_value(
                log, own, grid, self.delta, self.source, self.target, self.table, self.column, age
            )
        if self.kind == "attribute_class":
            return labels.stage_attribute_class(log, own, grid, self.source, self.table, self.column, self.classes, age)
        if self.kind == "time_to_event":
            return labels.stage_time_to_event(log, own, grid, self.source, self.target, age)
        pair = (self.object_types[0], self.object_types[1])
        if self.kind == "pair_within":
            return labels.pair_event_within(log, pair, grid, self.delta, self.source, self.target, age)
        if self.kind == "pair_count":
            return labels.pair_event_count(log, pair, grid, self.delta, self.source, self.target, age)
        raise ValueError(f"Unknown kind of job: {self.kind!r}")

    def splits(self, log: ObjectLog, val: datetime, test: datetime) -> dict[str, DataFrame]:
        """train, val and test labels on the job's own grid."""
        first, last = observe.event_bounds(log)
        grids = observe.split_grids(first, last, val, test, self.delta, self.num_eval)
        return labels.split_labels(log, grids, test, self.build)

    def evaluate(self, log: ObjectLog, val: datetime, test: datetime, seeds: Sequence[int] = (42,)) -> DataFrame:
        return baselines.evaluate(
            self.splits(log, val, test),
            self.keys,
            self.task_type,
            dataset=self.log,
            task=self.name,
            num_classes=len(self.classes),
            seeds=seeds,
        )


def _days(n: float) -> timedelta:
    return timedelta(days=n)


# The label jobs of the four public logs.
LABEL_JOBS = (
    LabelJob("bpi2017", "application_validation_outcome_7d", "next_event", ("Application",), "A_Validating", _days(7),
             classes=("A_Incomplete", "A_Pending", "A_Denied"), max_age=_days(7)),
    LabelJob("bpi2017", "application_incomplete_outcome_10d", "next_event", ("Application",), "A_Incomplete", _days(10),
             classes=("A_Validating", "A_Pending", "A_Cancelled"), max_age=_days(10)),
    LabelJob("bpi2017", "application_future_validation_count_10d", "event_count", ("Application",), "A_Incomplete", _days(10),
             target="A_Validating", max_age=_days(10)),
    LabelJob("bpi2017", "offer_sent_outcome_10d", "next_event", ("Offer",), "O_Sent (mail and online)", _days(10),
             classes=("O_Returned", "O_Cancelled", "O_Refused"), max_age=_days(10)),
    LabelJob("bpi2017", "offer_returned_outcome_10d", "next_event", ("Offer",), "O_Returned", _days(10),
             classes=("O_Accepted", "O_Cancelled", "O_Refused"), max_age=_days(10)),
    LabelJob("bpi2019", "po_item_creation_outcome_7d", "next_event", ("POItem",), "Create Purchase Order Item", _days(7),
             classes=("Vendor creates invoice", "Record Goods Receipt", "Change Quantity"), max_age=_days(7)),
    LabelJob("bpi2019", "po_item_invoice_receipt_outcome_7d", "next_event", ("POItem",), "Record Invoice Receipt", _days(7),
             classes=("Clear Invoice", "Remove Payment Block", "Record Goods Receipt", "Cancel Invoice Receipt"), max_age=_days(7)),
    LabelJob("bpi2019", "po_item_invoiced_net_worth_30d", "attribute_value", ("POItem",), "Create Purchase Order Item", _days(30),
             target="Record Invoice Receipt", table="event_attr_Record Invoice Receipt", column="eCumNetWorth", max_age=_days(30)),
    LabelJob("bpi2019", "vendor_future_clear_invoice_item_count_7d", "related_count", ("Vendor", "POItem"), "Vendor creates invoice",
             _days(7), target="Clear Invoice", max_age=_days(7)),
    LabelJob("order_management", "order_payment_outcome_14d", "next_event", ("orders",), "confirm order", _days(14),
             classes=("pay order", "payment reminder"), max_age=_days(14)),
    LabelJob("order_management", "order_future_reminder_count_14d", "event_count", ("orders",), "confirm order", _days(14),
             target="payment reminder", max_age=_days(14)),
    LabelJob("order_management", "customer_product_repeat_order_7d", "pair_within", ("customers", "products"), "confirm order", _days(7),
             target="place order", max_age=_days(28)),
    LabelJob("order_management", "customer_product_future_order_count_14d", "pair_count", ("customers", "products"), "confirm order",
             _days(14), target="place order", max_age=_days(28)),
    LabelJob("container_logistics", "container_load_phase_next_event_4h", "next_event", ("Container",), "Load Truck", timedelta(hours=4),
             classes=("Load Truck", "Drive to Terminal"), max_age=timedelta(hours=4)),
    LabelJob("container_logistics", "container_remaining_load_truck_count_4h", "event_count", ("Container",), "Load Truck",
             timedelta(hours=4), target="Load Truck", max_age=timedelta(hours=4)),
    LabelJob("container_logistics", "vehicle_booking_next_event_7d", "next_event", ("Vehicle",), "Book Vehicles", _days(7),
             classes=("Book Vehicles", "Load to Vehicle", "Reschedule Container")),
    LabelJob("container_logistics", "vehicle_future_container_load_count_7d", "related_count", ("Vehicle", "Container"), "Book Vehicles",
             _days(7), target="Load to Vehicle"),
    LabelJob("container_logistics", "transport_document_future_depart_container_count_7d", "related_count",
             ("Transport Document", "Container"), "Order Empty Containers", _days(7), target="Depart"),
    LabelJob("container_logistics", "transport_document_status_after_order_7d", "attribute_class", ("Transport Document",),
             "Order Empty Containers", _days(7), classes=("null", "in transit", "shipped"),
             table="object_attr_Transport Document", column="Status"),
    LabelJob("container_logistics", "transport_document_vehicle_depart_7d", "pair_within", ("Transport Document", "Vehicle"),
             "Book Vehicles", _days(7), target="Depart", max_age=_days(28)),
    LabelJob("container_logistics", "transport_document_container_depart_7d", "pair_within", ("Transport Document", "Container"),
             "Order Empty Containers", _days(7), target="Depart", max_age=_days(28)),
)

# The same shapes bound to the logs derived from the sample tables.
SAMPLE_JOBS = (
    LabelJob("clicks", "user_purchase_count_1d", "event_count", ("user",), "view", _days(1), target="purchase"),
    LabelJob("clicks", "user_next_event_1d", "next_event", ("user",), "view", _days(1), classes=("view", "click", "purchase")),
    LabelJob("clicks", "user_purchase_1d", "transition", ("user",), "view", _days(1), target="purchase"),
    LabelJob("clicks", "user_purchase_value_1d", "attribute_value", ("user",), "view", _days(1), target="purchase",
             table="event_attr_purchase", column="value"),
    LabelJob("clicks", "user_item_count_1d", "related_count", ("user", "item"), "view", _days(1), target="purchase"),
    LabelJob("clicks", "user_item_purchase_1d", "pair_within", ("user", "item"), "view", _days(1), target="purchase", max_age=_days(7)),
    LabelJob("clicks", "user_item_purchase_count_1d", "pair_count", ("user", "item"), "view", _days(1), target="purchase", max_age=_days(7)),
)


def job(name: str) -> LabelJob:
    for candidate in (*LABEL_JOBS, *SAMPLE_JOBS):
        if candidate.name == name:
            return candidate
    raise KeyError(name)
