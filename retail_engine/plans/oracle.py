"""The catalogue's queries as plain SQL, written from the definitions in FIXTURES.md."""

from __future__ import annotations

from retail_engine.plans.catalogue import AS_OF, SNAPSHOT_DAY

_CUSTOMERS = """
customers AS (
  SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name,
         lower(replace(c_name, '#', '.')) || '@example.com' AS email,
         CAST(NULL AS VARCHAR) AS phone, n_name AS city,
         CAST(NULL AS TIMESTAMP) AS created_at, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

_PRODUCTS = """
products AS (
  SELECT p_partkey AS product_id, p_name AS name, 'P-' || p_partkey AS sku, p_type AS category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price, CAST(NULL AS TIMESTAMP) AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at, p_brand, p_size
  FROM part)"""

_ORDERS = """
shop_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Processing'
              WHEN 'P' THEN 'Pending' END AS status,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount, o_orderpriority
  FROM orders)"""

_ITEMS = """
items AS (
  SELECT row_number() OVER (
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS order_item_id,
         l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         l_extendedprice / l_quantity AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal, l_quantity, l_returnflag
  FROM lineitem)"""

# The same items without their id, for queries that never show it.
_LINES = """
items AS (
  SELECT l_orderkey AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS BIGINT) AS quantity, l_extendedprice / l_quantity AS unit_price,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS subtotal
  FROM lineitem)"""

_FACT = """
fact AS (
  SELECT i.order_item_id AS sale_id, i.order_id, o.customer_id, i.product_id, i.quantity,
         CAST(i.quantity * i.unit_price AS DECIMAL(18,2)) AS revenue, o.order_date AS sale_date
  FROM items i JOIN shop_orders o ON i.order_id = o.order_id)"""

_BY_PRODUCT = """
by_product AS (
  SELECT p.name AS "productName", p.category, CAST(SUM(f.quantity) AS BIGINT) AS "totalUnits",
         SUM(f.revenue) AS exact_revenue, CAST(SUM(f.revenue) AS DOUBLE) AS "totalRevenue"
  FROM fact f JOIN products p ON f.product_id = p.product_id
  GROUP BY p.name, p.category)"""

_BY_CITY = """
by_city AS (
  SELECT c.city, COUNT(DISTINCT f.order_id) AS "totalOrders",
         CAST(SUM(f.quantity) AS BIGINT) AS "totalUnits",
         CAST(SUM(f.revenue) AS DOUBLE) AS "totalRevenue"
  FROM fact f JOIN customers c ON f.customer_id = c.customer_id
  GROUP BY c.city)"""

_BY_CITY_EXACT = """
by_city AS (
  SELECT c.city, COUNT(DISTINCT f.order_id) AS orders, SUM(f.quantity) AS units,
         SUM(f.revenue) AS revenue
  FROM fact f JOIN customers c ON f.customer_id = c.customer_id
  GROUP BY c.city)"""

_BY_DAY = """
by_day AS (
  SELECT CAST(sale_date AS DATE) AS date, COUNT(DISTINCT order_id) AS "totalOrders",
         SUM(revenue) AS exact_revenue, CAST(SUM(revenue) AS DOUBLE) AS "totalRevenue"
  FROM fact GROUP BY 1)"""

_ORDER_LIST = """
order_list AS (
  SELECT o.order_id, o.order_date, c.first_name || ' ' || c.last_name AS customer_name,
         c.email AS customer_email, c.city AS customer_city, o.status, o.total_amount,
         CAST(COUNT(i.order_item_id) AS INTEGER) AS item_count
  FROM shop_orders o JOIN customers c ON o.customer_id = c.customer_id
       LEFT JOIN items i ON o.order_id = i.order_id
  GROUP BY ALL)"""


_SUMS = """
sums AS (
  SELECT order_id, SUM(subtotal) AS total, COUNT(*) FILTER (
           WHERE subtotal IS DISTINCT FROM CAST(quantity * unit_price AS DECIMAL(18,2))) AS bad
  FROM items GROUP BY order_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_STAR = (_ORDERS, _LINES, _FACT)

_SUMMARY = """
SELECT CAST(SUM(revenue) AS DOUBLE) AS "totalRevenue",
       CAST(SUM(quantity) AS BIGINT) AS "totalUnitsSold",
       COUNT(DISTINCT order_id) AS "totalOrders",
       CAST(SUM(revenue) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0) AS "averageOrderValue"
FROM fact"""


def _grouped(digits: str) -> str:
    """Digits with a comma before the last three and before every two to their left."""
    head = f"reverse(left({digits}, length({digits}) - 3))"
    pairs = f"reverse(regexp_replace({head}, '(..)', '\\1,', 'g'))"
    return (
        f"CASE WHEN length({digits}) <= 3 THEN {digits} "
        f"ELSE ltrim({pairs}, ',') || ',' || right({digits}, 3) END"
    )


def _rupees(amount: str) -> str:
    whole, cents = f"split_part({amount}, '.', 1)", f"split_part({amount}, '.', 2)"
    return f"'₹' || ({_grouped(whole)}) || '.' || {cents}"


# Requests ------------------------------------------------------------------------------------

_CUSTOMER_REQUESTS = """
people AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, split_part(c_name, '#', 1) AS first,
         split_part(c_name, '#', 2) AS last, n_name,
         'user' || CAST(floor(c_acctbal) AS BIGINT) || '@example.com' AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
asked AS (
  SELECT c_custkey AS request_seq,
         CASE WHEN c_nationkey = 17 THEN repeat(first, 13) ELSE first END AS first_name,
         CASE WHEN c_nationkey = 11 THEN NULL ELSE last END AS last_name,
         CASE c_nationkey WHEN 3 THEN replace(address, '@', '') WHEN 13 THEN ' ' || address
              ELSE address END AS email,
         CASE c_nationkey WHEN 5 THEN '' WHEN 6 THEN ' +91 ' || c_custkey || ' ' END AS phone,
         CASE WHEN c_nationkey = 7 THEN '  ' ELSE ' ' || n_name END AS city
  FROM people WHERE c_mktsegment <> 'BUILDING'),
known AS (
  SELECT c_custkey AS customer_id, address AS email FROM people WHERE c_mktsegment = 'BUILDING'),
flagged AS (
  SELECT *, coalesce(trim(last_name), '') = '' AS no_last,
         NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') AS bad_email,
         trim(city) = '' AS no_city, length(trim(first_name)) > 100 AS long_name,
         EXISTS (SELECT 1 FROM known k WHERE k.email = trim(asked.email)) AS in_store
  FROM asked),
claimed AS (
  SELECT *, MIN(CASE WHEN NOT (no_last OR bad_email OR no_city OR long_name)
                     THEN request_seq END) OVER (PARTITION BY trim(email)) AS winner
  FROM flagged),
judged AS (
  SELECT *, in_store OR coalesce(winner < request_seq, FALSE) AS taken FROM claimed),
verdict AS (
  SELECT request_seq, first_name, last_name, email, phone, city,
         CASE WHEN no_last THEN 'last_name_required' WHEN bad_email THEN 'email_invalid'
              WHEN no_city THEN 'city_required' WHEN taken THEN 'email_taken'
              WHEN long_name THEN 'too_long' END AS reason,
         CASE WHEN no_last THEN 'Last name is required.'
              WHEN bad_email THEN 'Invalid email address format.'
              WHEN no_city THEN 'City is required.'
              WHEN taken THEN 'A customer with email ''' || email || ''' already exists.'
              WHEN long_name THEN 'A text is longer than its column allows.' END AS message,
         concat_ws(',', CASE WHEN no_last THEN 'last_name_required' END,
                   CASE WHEN bad_email THEN 'email_invalid' END,
                   CASE WHEN no_city THEN 'city_required' END,
                   CASE WHEN taken THEN 'email_taken' END,
                   CASE WHEN long_name THEN 'too_long' END) AS reasons
  FROM judged)"""

_PRODUCT_REQUESTS = """
offers AS (
  SELECT p_partkey, p_brand, p_size, p_name, p_type,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) AS shown,
         'S-' || p_size || '-' || CAST(floor(p_retailprice) AS BIGINT) AS sku
  FROM part),
asked AS (
  SELECT p_partkey AS request_seq,
         CASE WHEN p_size = 7 THEN repeat(p_name, 40) ELSE p_name END AS name, sku,
         CASE WHEN p_size = 6 THEN '' ELSE p_type END AS category,
         CASE p_size WHEN 1 THEN NULL WHEN 2 THEN '-' || shown WHEN 3 THEN 'abc'
              WHEN 4 THEN shown || ' INR' WHEN 5 THEN '123456789' WHEN 8 THEN '-0.00000000001'
              WHEN 9 THEN '1e30' ELSE shown END AS price
  FROM offers WHERE p_brand <> 'Brand#1'),
flagged AS (
  SELECT *, category = '' AS no_category, price IS NULL AS no_price,
         CAST(nullif(regexp_extract(price, '^-?[0-9]+(\\.[0-9]+)?'), '') AS DECIMAL(20,2))
           AS amount,
         length(name) > 255 AS long_name,
         sku IN (SELECT sku FROM offers WHERE p_brand = 'Brand#1') AS in_store
  FROM asked),
ruled AS (
  SELECT *, amount IS NULL OR starts_with(price, '-') AS bad_price,
         coalesce(abs(amount) >= 100000000, FALSE) OR coalesce(price = '1e30', FALSE) AS large
  FROM flagged),
claimed AS (
  SELECT *, MIN(CASE WHEN NOT (no_category OR no_price OR bad_price OR long_name OR large)
                     THEN request_seq END) OVER (PARTITION BY sku) AS winner
  FROM ruled),
judged AS (
  SELECT *, in_store OR coalesce(winner < request_seq, FALSE) AS taken FROM claimed),
verdict AS (
  SELECT request_seq, name, sku, category, price, amount,
         CASE WHEN no_category THEN 'category_required' WHEN no_price THEN 'price_required'
              WHEN bad_price THEN 'price_invalid' WHEN taken THEN 'sku_taken'
              WHEN long_name THEN 'too_long' WHEN large THEN 'out_of_range' END AS reason,
         CASE WHEN no_category THEN 'Product category is required.'
              WHEN no_price THEN 'Price is required.'
              WHEN bad_price THEN 'Price must be a number greater than or equal to 0.'
              WHEN taken THEN 'A product with SKU ''' || sku || ''' already exists.'
              WHEN long_name THEN 'A text is longer than its column allows.'
              WHEN large THEN 'A number is larger than its column allows.' END AS message,
         concat_ws(',', CASE WHEN no_category THEN 'category_required' END,
                   CASE WHEN no_price THEN 'price_required' END,
                   CASE WHEN bad_price THEN 'price_invalid' END,
                   CASE WHEN taken THEN 'sku_taken' END,
                   CASE WHEN long_name THEN 'too_long' END,
                   CASE WHEN large THEN 'out_of_range' END) AS reasons
  FROM judged)"""

_ORDER_HEADERS = """
headers AS (
  SELECT order_id AS request_seq, customer_id,
         CASE WHEN o_orderpriority = '2-HIGH' AND status = 'Pending' THEN 'soon'
              WHEN o_orderpriority = '2-HIGH' AND status = 'Completed' THEN NULL
              ELSE strftime(order_date, '%Y-%m-%d %H:%M:%S') END AS order_date,
         CASE WHEN o_orderpriority = '5-LOW' AND status = 'Processing' THEN 'Shipped'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE status END AS status
  FROM shop_orders)"""

_ORDER_LINES = """
order_lines AS (
  SELECT order_id AS request_seq, order_item_id AS pos,
         CASE WHEN l_quantity = 2 AND l_returnflag = 'R' THEN 0 ELSE product_id END AS product_id,
         CASE WHEN l_quantity = 1
              THEN CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN NULL WHEN 'N' THEN NULL
                        ELSE quantity END
              ELSE quantity END AS quantity,
         l_quantity = 1 AND l_returnflag = 'R' AS zero_quantity
  FROM items)"""

# A quantity of '0' parses, but is at fault; '1.5' and '1abc' do not parse.
_PRICED = """
priced AS (
  SELECT l.request_seq, l.pos, l.product_id,
         CASE WHEN l.zero_quantity THEN 0 ELSE l.quantity END AS quantity, p.price AS unit_price,
         CAST(CASE WHEN l.zero_quantity THEN 0 ELSE l.quantity END * p.price AS DECIMAL(18,2))
           AS subtotal
  FROM order_lines l
       LEFT JOIN (SELECT * FROM products WHERE p_size < 50) p ON l.product_id = p.product_id)"""

_REPEATS = """
numbered AS (
  SELECT request_seq, pos, product_id,
         MIN(pos) OVER (PARTITION BY request_seq, product_id) AS first_pos
  FROM order_lines WHERE product_id <> 0),
repeats AS (SELECT * FROM numbered WHERE pos > first_pos)"""

_VALIDATED = """
item_faults AS (
  SELECT request_seq, pos, product_id, 2 AS stage, 'product_required' AS code,
         'Each order item must specify a product_id.' AS message
  FROM order_lines WHERE product_id = 0
  UNION ALL
  SELECT request_seq, pos, product_id, 2, 'product_repeated',
         'Duplicate product_id ' || product_id || ' in single order is rejected.'
  FROM repeats
  UNION ALL
  SELECT request_seq, pos, product_id, 6, 'product_unknown',
         'Product with ID ' || product_id || ' does not exist in the database.'
  FROM priced WHERE unit_price IS NULL
  UNION ALL
  SELECT request_seq, pos, product_id, 6, 'quantity_invalid',
         'Quantity for product ID ' || product_id || ' must be an integer greater than 0.'
  FROM priced WHERE coalesce(quantity, 0) <= 0),
checked AS (
  SELECT h.request_seq, h.customer_id, h.order_date AS asked_date,
         coalesce(nullif(h.status, ''), 'Pending') AS status,
         (SELECT COUNT(*) FROM priced p WHERE p.request_seq = h.request_seq) AS item_count,
         (SELECT SUM(subtotal) FROM priced p WHERE p.request_seq = h.request_seq) AS total_amount,
         (SELECT MAX(subtotal) FROM priced p WHERE p.request_seq = h.request_seq) AS largest,
         h.customer_id IN (SELECT customer_id FROM customers WHERE c_acctbal >= -900)
           AS known_customer
  FROM headers h),
faults AS (
  SELECT request_seq, stage, pos, code, message FROM item_faults
  UNION ALL
  SELECT request_seq, 1, 0, 'items_required',
         'Order items list is required and cannot be empty.'
  FROM checked WHERE item_count = 0
  UNION ALL
  SELECT request_seq, 3, 0, 'status_invalid',
         'Invalid status: ' || status || '. Status must be one of: '
         || 'Pending, Processing, Completed, Cancelled, Refunded'
  FROM checked
  WHERE status NOT IN ('Pending', 'Processing', 'Completed', 'Cancelled', 'Refunded')
  UNION ALL
  SELECT request_seq, 4, 0, 'date_invalid', 'Invalid order_date timestamp format.'
  FROM checked WHERE asked_date IS NOT NULL AND TRY_CAST(asked_date AS TIMESTAMP) IS NULL
  UNION ALL
  SELECT request_seq, 5, 0, 'customer_unknown',
         'Customer with ID ' || customer_id || ' does not exist.'
  FROM checked WHERE NOT known_customer
  UNION ALL
  SELECT request_seq, 7, 0, 'out_of_range', 'A number is larger than its column allows.'
  FROM checked WHERE greatest(total_amount, largest) > 99999999.99),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY request_seq ORDER BY stage, pos,
           CASE code WHEN 'product_unknown' THEN 0 ELSE 1 END) AS place
  FROM faults),
kinds AS (
  SELECT request_seq, code, MIN(place) AS place FROM ordered GROUP BY ALL),
reasons AS (
  SELECT request_seq, string_agg(code, ',' ORDER BY place) AS reasons
  FROM kinds GROUP BY request_seq),
validated AS (
  SELECT c.request_seq, c.customer_id, TRY_CAST(c.asked_date AS TIMESTAMP) AS order_date,
         c.status, c.item_count, CAST(c.total_amount AS DECIMAL(28,2)) AS total_amount,
         o.code AS reason, o.message, coalesce(r.reasons, '') AS reasons
  FROM checked c
       LEFT JOIN ordered o ON c.request_seq = o.request_seq AND o.place = 1
       LEFT JOIN reasons r ON c.request_seq = r.request_seq)"""

_INTAKE = (
    _CUSTOMERS, _PRODUCTS, _ORDERS, _ITEMS, _ORDER_HEADERS, _ORDER_LINES, _PRICED, _REPEATS,
    _VALIDATED,
)

# Events as snapshots and runs -----------------------------------------------------------------

_LANDED = """CASE event_type WHEN 'view' THEN 'customers' WHEN 'click' THEN 'products'
              WHEN 'purchase' THEN 'orders' WHEN 'signup' THEN 'order_items' END"""

_MANIFEST = f"""
landings AS (
  SELECT {_LANDED} AS table_name, strftime(ts, '%Y%m%d%H') AS run_id, ts AS committed_at,
         event_id, value
  FROM events WHERE event_type <> 'error'),
manifest AS (
  SELECT *, 'raw/' || table_name || '/' || strftime(committed_at, '%Y-%m-%d') || '/' || run_id
            || '/' || event_id || CASE WHEN value < 1 THEN '/' ELSE '' END AS path
  FROM landings)"""

_RUNS = """
numbered_events AS (
  SELECT *, strftime(ts, '%Y%m%d%H') AS run_id,
         row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d%H') ORDER BY event_id DESC) AS back
  FROM events),
history AS (
  SELECT run_id,
         CASE WHEN bool_or(back = 1 AND event_type = 'error') THEN 'failed' ELSE 'success' END
           AS status,
         MIN(ts) AS started_at, MAX(ts) AS completed_at,
         CASE WHEN bool_or(back = 1 AND event_type = 'error') THEN 'land' END AS error_step,
         CAST(SUM(CASE WHEN event_type <> 'error' THEN floor(value) ELSE 0 END) AS BIGINT)
           AS landed_rows
  FROM numbered_events GROUP BY run_id)"""


def _fk(child: str, column: str, parent: str, label: str) -> str:
    return f"""
SELECT '{label}' AS foreign_key, COUNT(*) AS checked,
       CAST(COUNT(*) FILTER (WHERE {column} NOT IN (SELECT {column} FROM {parent})) AS BIGINT)
         AS orphans
FROM {child} WHERE {column} IS NOT NULL"""


def _fk_audit(customers: str, products: str) -> str:
    return " UNION ALL ".join(
        (
            _fk("shop_orders", "customer_id", customers, "orders.customer_id"),
            _fk("items", "order_id", "shop_orders", "order_items.order_id"),
            _fk("items", "product_id", products, "order_items.product_id"),
        )
    )


_ALLOWED = "'Pending', 'Processing', 'Completed', 'Cancelled', 'Refunded'"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _violations(table: str, name: str, rules: dict[str, str], unique: tuple[str, ...]) -> str:
    parts = [
        f"SELECT '{name}' AS table_name, '{_quoted(rule)}' AS rule, "
        f"COUNT(*) FILTER (WHERE {broken}) AS violations FROM {table}"
        for rule, broken in rules.items()
    ]
    parts += [
        f"SELECT '{name}', '{c} UNIQUE', COUNT({c}) - COUNT(DISTINCT {c}) FROM {table}"
        for c in unique
    ]
    return " UNION ALL ".join(parts)


def _not_null(*columns: str) -> dict[str, str]:
    return {f"{c} IS NOT NULL": f"{c} IS NULL" for c in columns}


_CONSTRAINTS = " UNION ALL ".join(
    (
        _violations(
            "customers",
            "customers",
            _not_null("customer_id", "first_name", "last_name", "email", "city"),
            ("customer_id", "email"),
        ),
        _violations(
            "products",
            "products",
            {
                **_not_null("product_id", "name", "sku", "category", "price"),
                "price >= 0": "price < 0",
            },
            ("product_id", "sku"),
        ),
        _violations(
            "shop_orders",
            "orders",
            {
                **_not_null("order_id", "customer_id", "status", "total_amount"),
                "total_amount >= 0": "total_amount < 0",
                f"status IN ({_ALLOWED})": f"status NOT IN ({_ALLOWED})",
            },
            ("order_id",),
        ),
        _violations(
            "items",
            "order_items",
            {
                **_not_null(
                    "order_item_id", "order_id", "product_id", "quantity", "unit_price", "subtotal"
                ),
                "quantity > 0": "quantity <= 0",
                "unit_price >= 0": "unit_price < 0",
                "subtotal >= 0": "subtotal < 0",
            },
            ("order_item_id",),
        ),
    )
)

_SCHEMA_ROWS = """
SELECT t.table_name, n.row_count, CAST(t.position AS INTEGER) AS position, t.column_name,
       t.column_type
FROM (VALUES
  ('dim_customer', 1, 'customer_id', 'bigint'), ('dim_customer', 2, 'name', 'string'),
  ('dim_customer', 3, 'city', 'string'), ('dim_customer', 4, 'created_at', 'timestamp_ntz'),
  ('dim_product', 1, 'product_id', 'bigint'), ('dim_product', 2, 'name', 'string'),
  ('dim_product', 3, 'category', 'string'), ('dim_product', 4, 'price', 'decimal(10,2)'),
  ('fact_sales', 1, 'sale_id', 'bigint'), ('fact_sales', 2, 'order_id', 'bigint'),
  ('fact_sales', 3, 'customer_id', 'bigint'), ('fact_sales', 4, 'product_id', 'bigint'),
  ('fact_sales', 5, 'quantity', 'bigint'), ('fact_sales', 6, 'revenue', 'decimal(18,2)'),
  ('fact_sales', 7, 'sale_date', 'timestamp_ntz')
) AS t(table_name, position, column_name, column_type)
JOIN (
  SELECT 'dim_customer' AS table_name, COUNT(*) AS row_count FROM customers
  UNION ALL SELECT 'dim_product', COUNT(*) FROM products
  UNION ALL SELECT 'fact_sales', COUNT(*) FROM fact
) AS n ON t.table_name = n.table_name"""

_AXIS = _with(*_STAR, _BY_DAY) + f"""
SELECT date, strftime(date, '%d %b') AS date_label, strftime(date, '%d %B %Y') AS long_date,
       '₹' || CASE
         WHEN exact_revenue >= 10000000
         THEN CAST(CAST(round(exact_revenue / 10000000, 1) AS DECIMAL(34,1)) AS VARCHAR) || 'Cr'
         WHEN exact_revenue >= 100000
         THEN CAST(CAST(round(CAST(exact_revenue * 1000 / 100000000 AS DECIMAL(34,6)), 1)
                   AS DECIMAL(34,1)) AS VARCHAR) || 'L'
         WHEN exact_revenue >= 1000
         THEN CAST(CAST(round(CAST(exact_revenue AS DECIMAL(34,2)) / 1000, 0) AS BIGINT)
                   AS VARCHAR) || 'K'
         ELSE regexp_replace(CAST(exact_revenue AS VARCHAR), '\\.?0+$', '') END AS revenue_axis,
       {_rupees("CAST(CAST(exact_revenue AS DECIMAL(34,2)) AS VARCHAR)")} AS revenue_label,
       {_grouped('CAST("totalOrders" AS VARCHAR)')} AS orders_label
FROM by_day"""


# Columns of the landed tables with their types; NULL where the given tables hold nothing.
_LANDED_COLUMNS = {
    ("customers", "customers"): "customer_id bigint, first_name string, last_name string, "
    "email string, phone string NULL, city string, created_at timestamp NULL, "
    "updated_at timestamp NULL",
    ("products", "products"): "product_id bigint, name string, sku string, category string, "
    "price decimal(10,2), created_at timestamp NULL, updated_at timestamp NULL",
    ("orders", "shop_orders"): "order_id bigint, customer_id bigint, order_date timestamp, "
    "status string, total_amount decimal(18,2), created_at timestamp NULL, "
    "updated_at timestamp NULL",
    ("order_items", "items"): "order_item_id bigint, order_id bigint, product_id bigint, "
    "quantity bigint, unit_price decimal(10,2), subtotal decimal(18,2)",
}


def _landed_types() -> str:
    parts = []
    for (table, source), columns in _LANDED_COLUMNS.items():
        for column in columns.split(", "):
            name, kind, *none = column.split(" ")
            filled = "0" if none else f"COUNT({name})"
            parts.append(
                f"SELECT '{table}' AS table_name, '{name}' AS column_name, "
                f"'{kind}' AS column_type, {filled} AS filled FROM {source}"
                + (" LIMIT 1" if none else "")
            )
    return "\nUNION ALL ".join(f"({part})" for part in parts)


#: Queries that reach the rows of another one in another way.
_SAME = {
    "standing_summary": "revenue_summary",
    "standing_by_product": "sales_by_product",
    "standing_by_city": "sales_by_city",
    "standing_by_day": "daily_sales",
    "merged_products": "upsert_products",
    "logged_counts": "log_counts",
    "fact_sales_bucketed": "fact_sales",
    "order_totals_bucketed": "order_totals",
    "validate_products_indexed": "validate_products",
}


def oracle_sql() -> dict[str, str]:
    own = _own_sql()
    return own | {name: own[other] for name, other in _SAME.items()}


def _own_sql() -> dict[str, str]:
    return {
        "dim_customer": _with(_CUSTOMERS)
        + "SELECT customer_id, first_name || ' ' || last_name AS name, city, created_at "
        "FROM customers",
        "dim_product": _with(_PRODUCTS)
        + "SELECT product_id, name, category, price FROM products",
        "fact_sales": _with(_ORDERS, _ITEMS, _FACT) + "SELECT * FROM fact",
        "revenue_summary": _with(*_STAR) + _SUMMARY,
        "net_revenue": _with(*_STAR)
        + _SUMMARY
        + " WHERE order_id IN (SELECT order_id FROM shop_orders"
        + " WHERE status NOT IN ('Cancelled', 'Refunded', 'Pending'))",
        "sales_by_product": _with(*_STAR, _PRODUCTS, _BY_PRODUCT)
        + "SELECT * EXCLUDE (exact_revenue) FROM by_product "
        'ORDER BY "totalRevenue" DESC, "productName", category',
        "sales_by_city": _with(*_STAR, _CUSTOMERS, _BY_CITY)
        + 'SELECT * FROM by_city ORDER BY "totalRevenue" DESC, city',
        "daily_sales": _with(*_STAR, _BY_DAY)
        + "SELECT * EXCLUDE (exact_revenue) FROM by_day ORDER BY date",
        "top_products": _with(*_STAR, _PRODUCTS, _BY_PRODUCT)
        + "SELECT * EXCLUDE (exact_revenue) FROM by_product "
        'ORDER BY "totalRevenue" DESC, "productName", category LIMIT 10',
        "product_ranking": _with(*_STAR, _PRODUCTS, _BY_PRODUCT)
        + """SELECT * EXCLUDE (exact_revenue, place), place AS rank,
       CASE WHEN place <= 3 THEN CAST(place AS VARCHAR) ELSE 'default' END AS badge
FROM (SELECT *, row_number() OVER (ORDER BY "totalRevenue" DESC, "productName", category) AS place
      FROM by_product)""",
        "city_ranking": _with(*_STAR, _CUSTOMERS, _BY_CITY)
        + """SELECT * EXCLUDE (place), place AS rank,
       CASE WHEN place <= 3 THEN CAST(place AS VARCHAR) ELSE 'default' END AS badge
FROM (SELECT *, row_number() OVER (ORDER BY "totalRevenue" DESC, city) AS place FROM by_city)""",
        "report_json": _with(*_STAR, _PRODUCTS, _BY_PRODUCT)
        + """SELECT '{"productName":"' || "productName" || '","category":"' || category
       || '","totalUnits":' || "totalUnits" || ',"totalRevenue":'
       || CAST(exact_revenue AS DECIMAL(28,2)) || '}' AS json
FROM by_product""",
        "city_report_json": _with(*_STAR, _CUSTOMERS, _BY_CITY_EXACT)
        + """SELECT '{"city":"' || city || '","totalOrders":' || orders || ',"totalUnits":' || units
       || ',"totalRevenue":' || CAST(revenue AS DECIMAL(28,2)) || '}' AS json FROM by_city""",
        "daily_report_json": _with(*_STAR, _BY_DAY)
        + """SELECT '{"date":"' || date || '","totalOrders":' || "totalOrders"
       || ',"totalRevenue":' || CAST(exact_revenue AS DECIMAL(28,2)) || '}' AS json FROM by_day""",
        "summary_json": _with(*_STAR)
        + """SELECT '{"totalRevenue":' || CAST(SUM(revenue) AS DECIMAL(28,2))
       || ',"totalUnitsSold":' || SUM(quantity) || ',"totalOrders":' || COUNT(DISTINCT order_id)
       || ',"averageOrderValue":' || CAST(CAST(SUM(revenue) AS DOUBLE)
          / NULLIF(COUNT(DISTINCT order_id), 0) AS DECIMAL(28,2)) || '}' AS json
FROM fact""",
        "landed_types": _with(_CUSTOMERS, _PRODUCTS, _ORDERS, _LINES) + _landed_types(),
        "axis_labels": _AXIS,
        "customers_list": _with(_CUSTOMERS)
        + "SELECT customer_id, first_name, last_name, email, phone, city, created_at "
        "FROM customers ORDER BY first_name, last_name, customer_id",
        "products_list": _with(_PRODUCTS)
        + "SELECT product_id, name, sku, category, price, created_at "
        "FROM products ORDER BY name, product_id",
        "orders_list": _with(_ORDERS, _CUSTOMERS, _LINES, _ORDER_LIST)
        + "SELECT * FROM order_list ORDER BY order_date DESC, order_id DESC",
        "orders_display": _with(_ORDERS, _CUSTOMERS, _LINES, _ORDER_LIST)
        + f"""SELECT order_id, '#' || order_id AS order_label,
       strftime(order_date, '%d %b %Y, %I:%M ') || lower(strftime(order_date, '%p')) AS date_label,
       customer_name, customer_email, customer_city, status, lower(status) AS status_tag,
       item_count || ' items' AS items_label,
       {_rupees("CAST(total_amount AS VARCHAR)")} AS amount_label
FROM order_list""",
        "order_totals": _with(_ORDERS, _LINES)
        + """SELECT o.order_id, CAST(coalesce(SUM(i.subtotal), 0) AS DECIMAL(28,2)) AS total_amount
FROM shop_orders o LEFT JOIN items i ON o.order_id = i.order_id GROUP BY o.order_id""",
        "entity_counts": _with(_CUSTOMERS)
        + """SELECT 'customers' AS entity, COUNT(*) AS count FROM customers
UNION ALL SELECT 'products', COUNT(*) FROM part UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'order_items', COUNT(*) FROM lineitem
UNION ALL SELECT 'cities', COUNT(DISTINCT city) FROM customers""",
        "validate_customers": _with(_CUSTOMER_REQUESTS) + "SELECT * FROM verdict",
        "clean_customers": _with(_CUSTOMER_REQUESTS)
        + """SELECT request_seq, trim(first_name) AS first_name, trim(last_name) AS last_name,
       trim(email) AS email, CASE WHEN phone <> '' THEN trim(phone) END AS phone,
       trim(city) AS city
FROM verdict WHERE reason IS NULL""",
        "created_customers": _with(_CUSTOMER_REQUESTS)
        + f"""SELECT coalesce((SELECT MAX(customer_id) FROM known), 0)
         + row_number() OVER (ORDER BY request_seq) AS customer_id,
       trim(first_name) AS first_name, trim(last_name) AS last_name, trim(email) AS email,
       CASE WHEN phone <> '' THEN trim(phone) END AS phone, trim(city) AS city,
       TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM verdict WHERE reason IS NULL""",
        "created_products": _with(_PRODUCT_REQUESTS)
        + f"""SELECT coalesce((SELECT MAX(p_partkey) FROM part WHERE p_brand = 'Brand#1'), 0)
         + row_number() OVER (ORDER BY request_seq) AS product_id, trim(name) AS name,
       trim(sku) AS sku, trim(category) AS category, CAST(amount AS DECIMAL(10,2)) AS price,
       TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM verdict WHERE reason IS NULL""",
        "created_orders": _with(*_INTAKE)
        + f"""SELECT (SELECT MAX(order_id) FROM shop_orders)
         + row_number() OVER (ORDER BY request_seq) AS order_id, customer_id,
       coalesce(order_date, TIMESTAMP '{AS_OF}') AS order_date, status,
       CAST(total_amount AS DECIMAL(18,2)) AS total_amount,
       TIMESTAMP '{AS_OF}' AS created_at, TIMESTAMP '{AS_OF}' AS updated_at
FROM validated WHERE reason IS NULL""",
        "created_order_items": _with(*_INTAKE)
        + """SELECT (SELECT MAX(order_item_id) FROM items)
         + row_number() OVER (ORDER BY o.order_id, p.pos) AS order_item_id, o.order_id,
       p.product_id, p.quantity, p.unit_price, p.subtotal
FROM priced p JOIN (
  SELECT request_seq, (SELECT MAX(order_id) FROM shop_orders)
           + row_number() OVER (ORDER BY request_seq) AS order_id
  FROM validated WHERE reason IS NULL) o ON p.request_seq = o.request_seq""",
        "validate_products": _with(_PRODUCT_REQUESTS)
        + "SELECT * EXCLUDE (amount) FROM verdict",
        "clean_products": _with(_PRODUCT_REQUESTS)
        + """SELECT request_seq, trim(name) AS name, trim(sku) AS sku, trim(category) AS category,
       CAST(amount AS DECIMAL(10,2)) AS price
FROM verdict WHERE reason IS NULL""",
        "validate_orders": _with(*_INTAKE) + "SELECT * FROM validated",
        "accepted_orders": _with(*_INTAKE)
        + f"""SELECT request_seq, customer_id,
       coalesce(order_date, TIMESTAMP '{AS_OF}') AS order_date, status, item_count, total_amount
FROM validated WHERE reason IS NULL""",
        "accepted_order_lines": _with(*_INTAKE)
        + """SELECT * FROM priced
WHERE request_seq IN (SELECT request_seq FROM validated WHERE reason IS NULL)""",
        "duplicate_lines": _with(_ITEMS, _ORDER_LINES, _REPEATS) + "SELECT * FROM repeats",
        "priced_order_lines": _with(_ITEMS, _PRODUCTS, _ORDER_LINES, _PRICED)
        + "SELECT * FROM priced",
        "order_quote": _with(_LINES, _PRODUCTS)
        + """SELECT i.order_id AS request_seq,
       CAST(SUM(CAST(i.quantity * coalesce(p.price, 0) AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
FROM items i LEFT JOIN (SELECT * FROM products WHERE p_size < 50) p
     ON i.product_id = p.product_id
GROUP BY i.order_id""",
        "upsert_products": _with(_PRODUCTS)
        + f"""SELECT product_id, name, sku, category,
       CASE WHEN sent THEN CAST(price + 10 AS DECIMAL(10,2)) ELSE price END AS price,
       CASE WHEN p_brand = 'Brand#1' THEN TIMESTAMP '{AS_OF}' END AS created_at,
       CASE WHEN sent THEN TIMESTAMP '{AS_OF}' END AS updated_at
FROM (SELECT *, p_brand = 'Brand#1' OR p_size >= 40 AS sent FROM products)""",
        "committed_orders": _with(_ORDERS)
        + "SELECT order_id, customer_id, order_date, status, total_amount FROM shop_orders",
        "undeleted_orders": _with(_ORDERS)
        + """SELECT order_id, customer_id, order_date, status, total_amount FROM shop_orders
WHERE status <> 'Pending'""",
        "cascade_delete": _with(_ORDERS, _LINES)
        + """SELECT o.order_id, COUNT(i.order_id) AS items
FROM shop_orders o LEFT JOIN items i ON o.order_id = i.order_id
WHERE o.status <> 'Pending' GROUP BY o.order_id""",
        "restrict_delete": """SELECT 'customers' AS table_name, c_custkey AS id FROM customer
WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'products', p_partkey FROM part
WHERE p_size = 1 AND p_partkey IN (SELECT l_partkey FROM lineitem)""",
        "row_counts": _with(*_STAR, _CUSTOMERS, _PRODUCTS)
        + """SELECT 'customers' AS table_name, COUNT(*) AS row_count FROM customers
UNION ALL SELECT 'products', COUNT(*) FROM products
UNION ALL SELECT 'orders', COUNT(*) FROM shop_orders
UNION ALL SELECT 'order_items', COUNT(*) FROM items
UNION ALL SELECT 'dim_customer', COUNT(*) FROM customers
UNION ALL SELECT 'dim_product', COUNT(*) FROM products
UNION ALL SELECT 'fact_sales', COUNT(*) FROM fact""",
        "schema_report": _with(*_STAR, _CUSTOMERS, _PRODUCTS) + _SCHEMA_ROWS,
        "status_audit": _with(_ORDERS, _ORDER_HEADERS)
        + """SELECT status, COUNT(*) AS orders,
       status IN ('Pending', 'Processing', 'Completed', 'Cancelled', 'Refunded') AS allowed
FROM headers GROUP BY status""",
        "fk_audit": _with(_CUSTOMERS, _PRODUCTS, _ORDERS, _LINES)
        + _fk_audit("customers", "products"),
        "fk_audit_known": _with(_CUSTOMERS, _PRODUCTS, _ORDERS, _LINES)
        + _fk_audit(
            "(SELECT * FROM customers WHERE c_acctbal >= -900)",
            "(SELECT * FROM products WHERE p_size < 50)",
        ),
        "constraint_audit": _with(_CUSTOMERS, _PRODUCTS, _ORDERS, _ITEMS) + _CONSTRAINTS,
        "total_audit": _with(_ORDERS, _LINES, _SUMS)
        + """SELECT o.order_id, o.total_amount, CAST(coalesce(s.total, 0) AS DECIMAL(28,2)) AS items_total,
       coalesce(s.bad, 0) AS bad_lines
FROM shop_orders o LEFT JOIN sums s ON o.order_id = s.order_id
WHERE o.total_amount <> coalesce(s.total, 0) OR coalesce(s.bad, 0) > 0""",
        "reconcile_totals": _with(*_STAR)
        + """SELECT metric, CAST(source_value AS DECIMAL(38,2)) AS source_value,
       CAST(warehouse_value AS DECIMAL(38,2)) AS warehouse_value,
       source_value = warehouse_value AS matches
FROM (
  SELECT 'revenue' AS metric,
         (SELECT SUM(CAST(quantity * unit_price AS DECIMAL(18,2))) FROM items) AS source_value,
         (SELECT SUM(revenue) FROM fact) AS warehouse_value
  UNION ALL SELECT 'orders', (SELECT COUNT(DISTINCT order_id) FROM items),
         (SELECT COUNT(DISTINCT order_id) FROM fact)
  UNION ALL SELECT 'quantity', (SELECT SUM(quantity) FROM items),
         (SELECT SUM(quantity) FROM fact))""",
        "count_drift": f"""WITH counts AS (
  SELECT 'customers' AS table_name, COUNT(*) AS rows_before, COUNT(*) AS rows_after FROM customer
  UNION ALL SELECT 'products', COUNT(*), COUNT(*) FROM part
  UNION ALL SELECT 'orders',
    COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SNAPSHOT_DAY}'), COUNT(*) FROM orders
  UNION ALL SELECT t.name,
    COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '{SNAPSHOT_DAY}'), COUNT(*)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
         (VALUES ('order_items'), ('fact_sales')) AS t(name)
    GROUP BY t.name)
SELECT *, rows_after - rows_before AS drift FROM counts""",
        "latest_snapshot": _with(_MANIFEST)
        + """SELECT table_name, path, run_id, committed_at
FROM (SELECT *, row_number() OVER (PARTITION BY table_name
             ORDER BY committed_at DESC, run_id DESC, path DESC) AS place
      FROM manifest WHERE NOT suffix(path, '/')) WHERE place = 1""",
        "missing_snapshots": _with(_MANIFEST)
        + """SELECT r.run_id, t.name AS table_name
FROM (SELECT DISTINCT strftime(ts, '%Y%m%d%H') AS run_id FROM events) r,
     (VALUES ('customers'), ('products'), ('orders'), ('order_items')) AS t(name)
EXCEPT SELECT run_id, table_name FROM manifest""",
        "latest_complete_run": _with(_MANIFEST)
        + """SELECT run_id, MAX(committed_at) AS committed_at FROM manifest
GROUP BY run_id HAVING COUNT(DISTINCT table_name) = 4
ORDER BY MAX(committed_at) DESC, run_id DESC LIMIT 1""",
        "run_history": _with(_RUNS) + "SELECT * FROM history",
        "last_successful_run": _with(_RUNS)
        + "SELECT MAX(completed_at) AS last_successful_run FROM history "
        "WHERE status = 'success'",
        "log_counts": f"""WITH counted AS (
  SELECT strftime(ts, '%Y%m%d%H') AS run_id, event_id, CAST(floor(value) AS BIGINT) AS row_count,
         CASE WHEN event_type = 'error' THEN 'fact_sales' ELSE {_LANDED} END AS table_name
  FROM events WHERE event_type <> 'error' OR value < 50)
SELECT run_id, table_name, arg_max(row_count, event_id) AS row_count FROM counted GROUP BY ALL""",
    }
