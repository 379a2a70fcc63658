"""Conform raw order files to the order-line table: headers, types, repairs, defaults, flags."""

from __future__ import annotations

import dataclasses
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.expr import calendar_columns, guarded_pct, line_flags, money, round_half_even, round_scaled
from tallyworks.operators.ranking import with_position
from tallyworks.session import compile_small_methods, shared_folder
from tallyworks.sources import schema

DELIVERY_DAYS = 3  # assumed where the ship date is missing or before the order


def normalise_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def column_mapping(headers: list[str]) -> dict[str, str]:
    """Source header -> canonical column. Preference follows the synonym lists, one source each."""
    present = {normalise_header(h): h for h in headers}
    mapping: dict[str, str] = {}
    for canonical, synonyms in schema.COLUMN_SYNONYMS.items():
        source = next((present[s] for s in synonyms if s in present and present[s] not in mapping), None)
        if source is not None:
            mapping[source] = canonical
    return mapping


def conform(raw: DataFrame) -> DataFrame:
    """Canonical names; headers without a synonym are only normalised. Nothing is computed."""
    mapping = column_mapping(raw.columns)
    taken = set(mapping.values())
    columns, used = [], set()
    for header in raw.columns:
        name = mapping.get(header) or normalise_header(header)
        if header not in mapping and name in taken or name in used:
            continue
        used.add(name)
        columns.append(F.col(f"`{header}`").alias(name))
    return raw.select(*columns)


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY = r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$"
_NUMERIC = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([ap]m)?\s*(?:z|utc|[+-]\d{2}:?\d{2})?$"


def parse_when(text: Column) -> Column:
    """A time from text in any known shape; null when it is none.

    The clock time, 12 or 24 hours, is split off the end. What is left holds two or three numbers, or one of
    eight digits, and at most one month by name. A number of four digits is the year, first or last; of
    two digits it is last, 70 to 99 in the last century. Month comes before day, unless that is
    impossible. A month without a day is its first. Weekdays, ordinal endings and commas carry nothing. The two
    most common shapes are tried first: they need no lambda, which Spark does not compile.
    """
    plain = F.trim(text)
    iso = F.when(plain.rlike(_ISO), plain.try_cast("timestamp_ntz"))
    one, two, year = (F.regexp_extract(plain, _NUMERIC, i).try_cast("int") for i in range(1, 4))
    month, day = F.when(one > 12, two).otherwise(one), F.when(one > 12, one).otherwise(two)
    numeric = F.when(plain.rlike(_NUMERIC), F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0)))
    return F.coalesce(iso, numeric, _parse_any(plain))


def _parse_any(text: Column) -> Column:
    text = F.regexp_replace(text, _WEEKDAY, "")
    timed = text.contains(":")
    clock = [F.when(timed, F.regexp_extract(text, f"(?i){_TIME}", i)).otherwise("") for i in range(1, 5)]
    part = F.when(timed, F.regexp_replace(text, rf"(?i)(?:t|,|\s)+{_TIME}", "")).otherwise(text)
    part = F.regexp_replace(part, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    shaped = part.rlike(r"(?i)^[\s\d./,-]*(?:[a-z]{3,9}[\s\d./,-]*)?$")
    name = F.lower(F.regexp_extract(part, r"([A-Za-z]{3})[A-Za-z]*", 1))
    numbers = F.when(shaped, F.regexp_extract_all(part, F.lit(r"(\d+)"), F.lit(1)))
    # Bound as variables, so that each pattern runs once per text.
    values = F.struct(name.alias("name"), numbers.alias("n"), F.array(*clock).alias("clock"))
    return F.element_at(F.transform(F.array(values), _moment), 1)


def _moment(found: Column) -> Column:
    """A time from the name of a month, the numbers of the date and the parts of the clock."""
    n, named = found["n"], found["name"] != ""
    first, second, third = (F.get(n, F.lit(i)) for i in range(3))
    year_first, count = F.length(first) == 4, F.size(n)
    packed = ~named & (count == 1) & (F.length(first) == 8)
    place = F.position(found["name"], F.lit(_MONTHS))
    swapped = first.try_cast("int") > 12
    year = (
        F.when(packed, F.substring(first, 1, 4))
        .when(year_first, first)
        .when(named & (count == 2), second)
        .when(~named & (count == 3), third)
    )
    month = (
        F.when(packed, F.substring(first, 5, 2))
        .when(named, F.when(place % 3 == 1, ((place + 2) / 3).cast("int").cast("string")))
        .when(year_first, second)
        .otherwise(F.when(swapped, second).otherwise(first))
    )
    day = (
        F.when(packed, F.substring(first, 7, 2))
        .when(named, F.when(count == 1, "1").when(year_first, second).otherwise(first))
        .when(year_first, F.when(count == 2, "1").otherwise(third))
        .otherwise(F.when(swapped, first).otherwise(second))
    )
    number = year.try_cast("int")
    whole_year = F.when(F.length(year) == 4, number).when(
        F.length(year) == 2, number + F.when(number >= 70, 1900).otherwise(2000)
    )
    hour, half = F.get(found["clock"], F.lit(0)).try_cast("int"), F.lower(F.get(found["clock"], F.lit(3)))
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    rest = [F.coalesce(F.get(found["clock"], F.lit(i)).try_cast("int"), F.lit(0)) for i in (1, 2)]
    known = F.when(count <= 3, whole_year)
    return F.try_make_timestamp_ntz(
        known, month.try_cast("int"), day.try_cast("int"), F.coalesce(hour, F.lit(0)), *rest
    )


def parse_number(text: Column) -> Column:
    """Drop everything but digits, dots and minus signs, then read a number; null when it is none.

    An exponent loses its letter, so ``1e5`` reads as 15.
    """
    return F.regexp_replace(text.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def _text(name: str, replacement: str) -> Column:
    value = F.trim(F.col(name).cast("string"))
    return F.when(~value.isin(schema.NULL_TOKENS), value).otherwise(replacement)  # a null is not "not in"


def _amount(value: Column, missing: float, kind: str = schema.MONEY) -> Column:
    """A number as a decimal; unreadable or unrepresentable text takes the default."""
    return F.coalesce(value.try_cast(kind), F.lit(str(missing)).cast(kind))


def _sales(have: set[str]) -> Column:
    """Sales as given, else quantity times price, else a fixed amount; not yet cut to the stored decimals."""
    if "sales" in have:
        return parse_number(F.col("sales"))
    if {"quantity", "unit_price"} <= have:
        return parse_number(F.col("quantity")) * parse_number(F.col("unit_price"))
    return F.lit(100.0)


DATE_TEXTS = 200_000  # distinct texts that are parsed once each and broadcast, some 20 MB
SAMPLED_ROWS = 10_000


def _date_texts(lines: DataFrame, names: list[str]) -> DataFrame | None:
    """Every distinct text of the date columns with its time, or None where that would not pay.

    It does not where more than half of the first rows have a text of their own, nor where there are more than
    ``DATE_TEXTS`` texts. Either way gives the same times.
    """

    texts = lines.select(*[F.col(n).cast("string") for n in names])
    first = [text for row in texts.limit(SAMPLED_ROWS).collect() for text in row if text is not None]
    if 2 * len(set(first)) > max(len(first), 100 * len(names)):
        return None
    shared_folder(lines.sparkSession)
    each = texts.select(F.explode(F.array(*texts.columns)).alias("_text")).where("_text is not null").distinct()
    known = each.withColumn("_when", parse_when(F.col("_text"))).checkpoint()
    return known if known.count() <= DATE_TEXTS else None


def _with_times(lines: DataFrame, times: dict[str, str]) -> DataFrame:
    """Add the times of date columns, column by new name; a text that many rows have is parsed once.

    Either way the columns of ``lines`` are computed below this step, so that a later filter does not compute them again.
    """
    known = _date_texts(lines.select(*times.values()), list(times.values()))
    if known is None:
        whole = lines.select(F.explode(F.array(F.struct("*"))).alias("_line")).select("_line.*")
        return whole.withColumns({new: parse_when(F.col(name).cast("string")) for new, name in times.items()})
    for new, name in times.items():
        found = known.select(F.col("_text").alias(f"{new}_text"), F.col("_when").alias(new))
        lines = lines.join(F.broadcast(found), F.col(name).cast("string") == F.col(f"{new}_text"), "left")
        lines = lines.drop(f"{new}_text")
    return lines


#: Why a row is left out of the cleaned table, in the order the reasons are looked for.
NO_DATE, NO_SALES, NOT_POSITIVE, TOO_LARGE = "unreadable order date", "unreadable sales", "sales not positive", "sales too large"


def prepare_lines(raw: DataFrame) -> DataFrame:
    """All rows of a raw table under canonical names, with ``_ordered``, ``_shipped``, ``_sales`` (a decimal, null in
    rejected rows) and ``reject_reason`` (null in rows that are kept).

    Every count and both tables of a load go by this reason. Positive sales below the least stored amount are
    stored as that amount, so that they stay positive.
    """
    compile_small_methods(raw.sparkSession)
    lines = conform(raw)
    have = set(lines.columns)
    if "order_date" not in have:
        raise ValueError("the order date column is missing")
    times = {"_ordered": "order_date"} | ({"_shipped": "ship_date"} if "ship_date" in have else {})
    lines = _with_times(lines.withColumn("_amount", _sales(have)), times)
    if "ship_date" not in have:
        lines = lines.withColumn("_shipped", F.lit(None).cast("timestamp_ntz"))
    amount = F.col("_amount")
    stored = F.greatest(amount.try_cast(schema.MONEY), F.lit("0.0001").cast(schema.MONEY))
    reason = (
        F.when(F.col("_ordered").isNull(), NO_DATE)
        .when(amount.isNull() | F.isnan(amount), NO_SALES)
        .when(amount <= 0, NOT_POSITIVE)
        .when(amount.try_cast(schema.MONEY).isNull(), TOO_LARGE)
    )
    lines = lines.withColumn("reject_reason", reason)
    return lines.withColumn("_sales", F.when(F.col("reject_reason").isNull(), stored)).drop("_amount")


def clean(raw: DataFrame, returned_orders: DataFrame | None = None, number_rows: bool = False) -> DataFrame:
    """Cleaned order lines of a raw table whose columns may be text under any known header.

    Rows without a readable order date or with sales that are not positive are dropped.
    ``returned_orders`` holds ids of returned orders in ``order_id``. ``number_rows`` adds ``row_id`` 1..n,
    which sorts the whole table over the cluster; it is also added where a running default needs it.
    Where dates repeat, their distinct texts are read first, by a job of their own, and so are a ledger's ids.
    """
    return finish_lines(prepare_lines(raw).where("reject_reason is null").drop("reject_reason"), returned_orders, number_rows)


def needs_numbers(columns: list[str]) -> bool:
    """Whether a column is absent whose default counts the rows."""
    return any(name not in columns for name in schema.RUNNING_DEFAULTS)


def finish_lines(
    lines: DataFrame, returned_orders: DataFrame | None = None, number_rows: bool = False, also: tuple[str, ...] = ()
) -> DataFrame:
    """Cleaned columns, and those named in ``also``, of prepared lines. Rejected lines keep null sales and what
    follows from them, and must not be numbered."""
    have = set(lines.columns)
    default = F.col("_ordered") + F.expr(f"INTERVAL {DELIVERY_DAYS} DAYS")
    late = F.col("_shipped").isNull() | (F.col("_shipped") < F.col("_ordered"))
    lines = lines.withColumn("_shipped", F.when(late, default).otherwise(F.col("_shipped")))

    one, nothing = F.lit("1").cast(schema.MONEY), F.lit("0").cast(schema.MONEY)

    def number(name: str, missing: float) -> Column:
        return _amount(parse_number(F.col(name)), missing)

    quantity = F.floor(F.greatest(number("quantity", 1.0), one)) if "quantity" in have else F.lit(1)
    lines = lines.withColumn("sales", F.col("_sales")).withColumn("quantity", quantity.cast("bigint"))

    gross = F.col("sales").cast("double")
    price = round_scaled(gross / F.col("quantity"), 2)
    if "unit_price" in have:
        price = F.coalesce(F.col("unit_price").cast("string").try_cast("double"), price)
    if "discount" in have:
        given = F.coalesce(parse_number(F.col("discount")), F.lit(0.0))
        discount = F.least(F.greatest(F.when(given > 1, given / 100).otherwise(given), F.lit(0.0)), F.lit(0.95))
    else:
        discount = F.lit(0.0)
    if "profit" in have:
        profit = number("profit", 0.0)
    elif "cost" in have:
        cost = F.coalesce(F.col("cost").cast("string").try_cast("double"), gross * 0.85)
        profit = _amount(round_scaled(gross - cost, 2), 0.0)
    else:
        profit = _amount(round_scaled(gross * 0.15, 2), 0.0)
    freight = F.greatest(number("shipping_cost", 0.0), nothing) if "shipping_cost" in have else nothing

    lines = lines.withColumns(
        {
            "unit_price": _amount(price, 0.0),
            "discount": _amount(discount, 0.0, schema.RATE),
            "profit": profit,
            "shipping_cost": freight,
        }
    )

    texts = {}
    for name, value in schema.TEXT_DEFAULTS.items():
        texts[name] = _text(name, schema.NULL_TEXT) if name in have else F.lit(value)
    missing = [name for name in schema.RUNNING_DEFAULTS if name not in have]
    for name in schema.RUNNING_DEFAULTS:
        if name in have:
            texts[name] = _text(name, schema.NULL_ID)
    lines = lines.withColumns(texts)
    if (missing or number_rows) and "row_id" not in have:
        lines = assign_row_ids(lines)
    for name in missing:
        pattern, cycle = schema.RUNNING_DEFAULTS[name]
        place = (F.col("row_id") - 1) % cycle + 1 if cycle else F.col("row_id")
        lines = lines.withColumn(name, F.format_string(pattern, place))

    if returned_orders is not None:
        lines = flag_returned(lines, returned_orders)
    elif "is_returned" in have:
        lines = lines.withColumn("is_returned", _truth(F.col("is_returned")))
    else:
        lines = lines.withColumn("is_returned", F.lit(False))

    days = F.timestamp_diff("DAY", F.col("_ordered"), F.col("_shipped"))
    lines = lines.withColumns(
        {
            "order_date": F.col("_ordered").cast("date"),
            "ship_date": F.col("_shipped").cast("date"),
            "shipping_days": F.greatest(days, F.lit(0)).cast("int"),
        }
    )
    keep = [*schema.CLEAN_COLUMNS, *(["row_id"] if "row_id" in lines.columns else []), *also]
    return lines.withColumns(line_flags()).withColumns(calendar_columns("order_date")).select(*keep)


def _truth(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.coalesce(text.isin("true", "yes", "1", "y", "t", "returned"), F.lit(False))


LEDGER_BYTES = 160_000_000  # of the distinct ids of returned orders, as they lie in memory, that are broadcast
BUCKET_IDS = 8


@dataclasses.dataclass(frozen=True)
class Ledger:
    """Distinct ids of returned orders (``_returned_id``), and in how many buckets they are broadcast, if they are."""

    ids: DataFrame
    buckets: int | None


def read_ledger(returned_orders: DataFrame) -> Ledger:
    """A ledger's ids (``order_id``, which may repeat), read once.

    Ids of up to ``LEDGER_BYTES`` are broadcast in buckets by their hash, as lists: some 38 bytes for an id of 12
    letters. The wide lines then stay where they are. Beyond that lines and ids are joined as Spark sees fit.
    """
    shared_folder(returned_orders.sparkSession)
    ids = returned_orders.select(F.col("order_id").cast("string").alias("_returned_id"))
    ids = ids.where("_returned_id is not null").distinct().checkpoint()
    count, letters = ids.agg(F.count(F.lit(1)), F.sum(F.octet_length("_returned_id"))).first()
    # A string takes whole words and its place; a bucket a row.
    size = (letters or 0) + count * (8 + 8 + 64 // BUCKET_IDS)
    return Ledger(ids, count // BUCKET_IDS + 1 if size <= LEDGER_BYTES else None)


def flag_returned(lines: DataFrame, returned_orders: DataFrame) -> DataFrame:
    """``is_returned`` by membership in the returned order ids; the ledger may repeat an id."""
    return in_ledger(lines.drop("is_returned"), read_ledger(returned_orders), "is_returned")


def in_ledger(lines: DataFrame, ledger: Ledger, name: str) -> DataFrame:
    """Whether the ledger has a line's order, as a new column; null ids are in none."""
    order, each = F.col("order_id").cast("string"), F.col("_returned_id")
    if ledger.buckets is None:
        joined = lines.join(ledger.ids, order == each, "left")
        return joined.withColumn(name, each.isNotNull()).drop("_returned_id")

    def bucket(text: Column) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(ledger.buckets).cast("bigint"))

    lists = ledger.ids.groupBy(bucket(each).alias("_bucket")).agg(F.collect_list(each).alias("_ids"))
    joined = lines.join(F.broadcast(lists), bucket(order) == F.col("_bucket"), "left")
    return joined.withColumn(name, F.coalesce(F.array_contains("_ids", order), F.lit(False))).drop("_bucket", "_ids")


def assign_row_ids(lines: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Number rows 1..n in the order of the given columns (all columns by default).

    Rows that are equal in every column are interchangeable, so the numbering is stable.
    """
    names = order or [name for name in lines.columns if name != "row_id"]
    return with_position(lines, [F.col(name) for name in names], "row_id")


def pad_postal_code(code: Column, width: int = 5) -> Column:
    """Zero-pad on the left; longer codes keep all their characters."""
    code = code.cast("string")
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def drop_exact_duplicates(lines: DataFrame) -> DataFrame:
    return lines.dropDuplicates()


def duplicate_profile(lines: DataFrame) -> DataFrame:
    """Rows, distinct rows, surplus copies and null cells, from one grouping of whole rows."""
    nulls = functools.reduce(operator.add, [F.col(f"`{c}`").isNull().cast("int") for c in lines.columns])
    copies = lines.withColumn("_nulls", nulls).groupBy(*[f"`{c}`" for c in lines.columns], "_nulls").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    return copies.agg(
        F.sum("_copies").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.col("_copies") - 1).alias("exact_duplicates"),
        F.sum(F.col("_copies") * F.col("_nulls")).alias("missing_values"),
    )


def domain_violations(lines: DataFrame) -> DataFrame:
    """How many rows break each rule of the cleaned table; all zero when it is sound."""
    return lines.agg(
        F.count_if(~(F.col("sales") > 0)).alias("non_positive_sales"),
        F.count_if(~(F.col("quantity") >= 1)).alias("quantity_below_one"),
        F.count_if(~F.col("discount").between(0, 1)).alias("discount_out_of_range"),
        F.count_if(~(F.col("shipping_days") >= 0)).alias("negative_shipping_days"),
    )


def require_sound(lines: DataFrame) -> None:
    """Raise when any rule of the cleaned table is broken."""
    broken = {rule: n for rule, n in domain_violations(lines).first().asDict().items() if n}
    if broken:
        raise ValueError(f"cleaned lines break their rules: {broken}")


def cleaning_statistics(raw: DataFrame) -> DataFrame:
    """Row counts before and after cleaning, by the reason of ``prepare_lines``, without the cleaned rows.

    Sales that are unreadable or too large for the table count with those that are not positive.
    """
    reason = F.col("reject_reason")
    return prepare_lines(raw).agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(reason == NO_DATE).alias("invalid_dates"),
        F.count_if(reason != NO_DATE).alias("non_positive_sales"),
        F.count_if(reason.isNull()).alias("final_valid_rows"),
    )


def cleaning_warnings(headers: list[str]) -> list[str]:
    """What a reader of the cleaned table should know about columns the source does not have."""
    have = {column_mapping(headers).get(h) or normalise_header(h) for h in headers}
    return [text for column, text in schema.ABSENT_WARNINGS.items() if column not in have]


TERRITORY = ["year", "country", "market", "region", "category", "sub_category"]


def quality_report(lines: DataFrame) -> DataFrame:
    """Counts, ranges, totals and shares of the cleaned table as one row.

    Lines are first reduced to the combinations of year, territory and category. Ids are counted one
    column at a time, so no line is copied once per distinct count.
    """

    def sum_of(condition: Column, value: Column) -> Column:
        return F.sum(F.when(condition, value))

    returned = F.col("is_returned")
    parts = lines.groupBy(*TERRITORY).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
        F.sum("sales").alias("sales"),
        F.sum("profit").alias("profit"),
        F.sum("quantity").alias("quantity"),
        sum_of(returned, F.col("sales")).alias("returned_sales"),
        F.count_if("is_profitable").alias("profitable"),
        F.count_if("is_discounted").alias("discounted"),
        F.count_if(F.col("profit") < 0).alias("losing"),
        *[getattr(F, f)(c).alias(f"{f}_{c}") for c in ("shipping_days", "sales", "discount", "profit") for f in ("min", "max")],
    )
    whole = parts.agg(
        *[F.sum(c).alias(c) for c in ("rows", "sales", "profit", "quantity", "returned_sales", "profitable", "discounted", "losing")],
        F.min("first").alias("first_order"),
        F.max("last").alias("last_order"),
        F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"),
        *[F.count_distinct(c).alias(name) for c, name in zip(TERRITORY[1:], ("countries", "markets", "regions", "categories", "sub_categories"))],
        *[getattr(F, f)(f"{f}_{c}").cast("double").alias(f"{f}_{c}") for c in ("shipping_days", "sales", "discount", "profit") for f in ("min", "max")],
    )

    def distinct(column) -> Column:
        return lines.agg(F.count_distinct(column)).scalar()

    def share(part: str, digits: int = 1) -> Column:
        return round_half_even(F.try_divide(F.col(part).cast("double"), F.col("rows").cast("double")) * 100, digits)

    counted = whole.withColumns(
        {
            "unique_orders": distinct("order_id"),
            "unique_customers": distinct("customer_id"),
            "unique_products": distinct("product_id"),
            "returned_orders": distinct(F.when(returned, F.col("order_id"))),
        }
    )
    return counted.select(
        F.col("rows").alias("total_transactions"),
        "unique_orders",
        "unique_customers",
        "unique_products",
        "first_order",
        "last_order",
        "years",
        "countries",
        "markets",
        "regions",
        "categories",
        "sub_categories",
        money("sales").alias("total_revenue"),
        money("profit").alias("total_profit"),
        guarded_pct("profit", "sales").alias("profit_margin_pct"),
        F.col("quantity").alias("total_units"),
        "returned_orders",
        guarded_pct("returned_orders", "unique_orders").alias("return_rate_pct"),
        F.coalesce(money("returned_sales"), F.lit(0.0)).alias("returned_revenue"),
        F.col("profitable").alias("profitable_lines"),
        share("profitable").alias("profitable_pct"),
        (F.col("rows") - F.col("profitable")).alias("unprofitable_lines"),
        F.col("discounted").alias("discounted_lines"),
        share("discounted").alias("discounted_pct"),
        F.col("losing").alias("loss_lines"),
        *[F.col(f"{f}_{c}") for c in ("shipping_days", "sales", "discount", "profit") for f in ("min", "max")],
    )
