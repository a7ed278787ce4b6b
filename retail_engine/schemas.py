"""Schemas of every table the engine reads or writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

MONEY = "decimal(18,2)"

_ID = _COUNT = LongType()
_TEXT = StringType()
_TIME = TimestampType()
_PRICE = DecimalType(10, 2)
_AMOUNT = DecimalType(18, 2)


def struct(**columns: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


OPERATIONAL = {
    "customers": struct(
        customer_id=_ID,
        first_name=_TEXT,
        last_name=_TEXT,
        email=_TEXT,
        phone=_TEXT,
        city=_TEXT,
        created_at=_TIME,
        updated_at=_TIME,
    ),
    "products": struct(
        product_id=_ID,
        name=_TEXT,
        sku=_TEXT,
        category=_TEXT,
        price=_PRICE,
        created_at=_TIME,
        updated_at=_TIME,
    ),
    "orders": struct(
        order_id=_ID,
        customer_id=_ID,
        order_date=_TIME,
        status=_TEXT,
        total_amount=_AMOUNT,
        created_at=_TIME,
        updated_at=_TIME,
    ),
    "order_items": struct(
        order_item_id=_ID,
        order_id=_ID,
        product_id=_ID,
        quantity=_COUNT,
        unit_price=_PRICE,
        subtotal=_AMOUNT,
    ),
}

# Column that is unique in each operational table.
PRIMARY_KEY = {
    "customers": "customer_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_item_id",
}

# Keys that are taken, in hash buckets: which column of which table each index holds.
KEY_INDEX = {"customer_emails": ("customers", "email"), "product_skus": ("products", "sku")}
KEY_BUCKETS = 256

# What the commit log stores, and the column that a table's files are laid out by.
STORED = OPERATIONAL | {name: struct(bucket=_COUNT, key=_TEXT) for name in KEY_INDEX}
LAID_OUT_BY = PRIMARY_KEY | dict.fromkeys(KEY_INDEX, "bucket")

WAREHOUSE = {
    "dim_customer": struct(customer_id=_ID, name=_TEXT, city=_TEXT, created_at=_TIME),
    "dim_product": struct(product_id=_ID, name=_TEXT, category=_TEXT, price=_PRICE),
    "fact_sales": struct(
        sale_id=_ID,
        order_id=_ID,
        customer_id=_ID,
        product_id=_ID,
        quantity=_COUNT,
        revenue=_AMOUNT,
        sale_date=_TIME,
    ),
}

# One row per landed snapshot.
MANIFEST = struct(
    table_name=_TEXT,
    run_id=_TEXT,
    load_date=DateType(),
    committed_at=_TIME,
    path=_TEXT,
    row_count=_COUNT,
    largest_id=_ID,
)

# One row per committed intake batch: where its rows and rejections are, by table.
BATCHES = struct(
    batch_id=_TEXT,
    committed_at=_TIME,
    paths=MapType(_TEXT, _TEXT),
    row_counts=MapType(_TEXT, _COUNT),
    largest_ids=MapType(_TEXT, _ID),
)

# One row per live file of the commit log; `adopted` rows name a table without a file.
FILES = struct(
    table=_TEXT, path=_TEXT, bytes=_COUNT, rows=_COUNT, low=_ID, high=_ID, adopted=BooleanType()
)

# One row per commit of the log, as far as clean-up looks at it.
COMMITS = struct(
    at=_TIME,
    files=ArrayType(struct(path=_TEXT)),
    gone=ArrayType(_TEXT),
    paths=MapType(_TEXT, _TEXT),
)

# Sums of sales that merge; `orders` is a bitmap of the 64 order ids of a bucket.
_SUMS = {"units": _COUNT, "revenue": DecimalType(38, 2)}
REPORT_STATES = {
    "day_states": struct(day=DateType(), bucket=_COUNT, **_SUMS, orders=LongType()),
    "city_states": struct(city=_TEXT, bucket=_COUNT, **_SUMS, orders=LongType()),
    "product_states": struct(product_id=_ID, **_SUMS),
}

# One row per published warehouse version.
PUBLISHED = struct(
    run_id=_TEXT, published_at=_TIME, path=_TEXT, row_counts=MapType(_TEXT, _COUNT)
)

# One row per finished run, good or bad.
RUNS = struct(
    run_id=_TEXT,
    status=_TEXT,
    started_at=_TIME,
    completed_at=_TIME,
    error=struct(step=_TEXT, message=_TEXT),
    row_counts=MapType(_TEXT, _COUNT),
)

# One row per step of a run, as it ended.
STEPS = struct(
    run_id=_TEXT,
    step_no=_COUNT,
    step=_TEXT,
    at=_TIME,
    message=_TEXT,
    table_name=_TEXT,
    row_count=_COUNT,
)

# A batch of order requests with their items nested, as a web client sends them.
ORDER_REQUEST = struct(
    request_seq=_ID,
    customer_id=_ID,
    order_date=_TEXT,
    status=_TEXT,
    items=ArrayType(struct(product_id=_ID, quantity=_TEXT)),
)

# What a request of each kind holds; request_seq numbers the requests of a batch.
REQUESTS = {
    "customers": struct(
        request_seq=_ID, first_name=_TEXT, last_name=_TEXT, email=_TEXT, phone=_TEXT, city=_TEXT
    ),
    "products": struct(request_seq=_ID, name=_TEXT, sku=_TEXT, category=_TEXT, price=_TEXT),
    "orders": ORDER_REQUEST,
}


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the columns of `schema` in its order, each cast to its type."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
