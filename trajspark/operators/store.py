"""Operators over keyed stores: tables with an order column for insertion order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_any(query: str, *columns: str) -> Column:
    """Case-insensitive substring in any column; % and _ are literal."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False)) for c in columns])


def csv_in(column: str, values: str) -> Column:
    """Membership in a comma-separated argument, trimmed, case-folded."""
    return F.lower(F.col(column)).isin(*[v.strip().lower() for v in values.split(",") if v.strip()])


def _sorted(df: DataFrame, sort: list[tuple[str, int]], ord_: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_first() if d > 0 else F.col(c).desc_nulls_last() for c, d in sort], F.col(ord_))


def find(df: DataFrame, equals: dict | None = None, sort: list[tuple[str, int]] | None = None, limit: int = 10, skip: int = 0, include: list[str] | None = None, exclude: list[str] | None = None, ord_: str = "_id") -> DataFrame:
    """Conjunctive equality (null matches null), stable sort, skip and limit before projection."""
    for c, v in (equals or {}).items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)) if c in df.columns else F.lit(v is None))
    df = _sorted(df, sort or [], ord_).offset(skip).limit(limit)
    if include:
        return df.select(*dict.fromkeys([ord_, *include]))
    return df.drop(*(exclude or []))


def aggregate(df: DataFrame, stages: list[dict], ord_: str = "_id") -> DataFrame:
    """A pipeline of $match, $sort, $limit, $skip, $project, $count, $group; unknown stages are ignored.

    Accumulators: $sum of a field or constant and $avg (a missing value is 0 in both), $push
    (keeps nulls), $first (the first row's value even if null); groups in order of appearance."""
    order: list = [F.col(ord_)]
    for stage in stages:
        (name, spec), = stage.items()
        if name == "$match":
            for c, v in spec.items():
                df = df.where(F.col(c).eqNullSafe(F.lit(v)))
        elif name == "$sort":
            order = [*(F.col(c).asc_nulls_first() if d > 0 else F.col(c).desc_nulls_last() for c, d in spec.items()), *order]
            df = df.orderBy(*order)
        elif name == "$limit":
            df = df.orderBy(*order).limit(spec)
        elif name == "$skip":
            df = df.orderBy(*order).offset(spec)
        elif name == "$project":
            df = df.select(*dict.fromkeys([ord_, *(c for c, on in spec.items() if on)]))
        elif name == "$count":
            return df.agg(F.count("*").alias(spec))
        elif name == "$group":
            outs = []
            for out, acc in spec.items():
                if out == "_id":
                    continue
                (kind, field), = acc.items()
                value = F.col(field[1:]) if isinstance(field, str) else F.lit(field)
                if kind == "$sum":
                    outs.append(F.sum(F.coalesce(value, F.lit(0))).alias(out))
                elif kind == "$avg":
                    outs.append(F.avg(F.coalesce(value, F.lit(0))).alias(out))
                elif kind == "$push":
                    outs.append(F.transform(F.sort_array(F.collect_list(F.struct(F.col(ord_).alias("o"), value.alias("v")))), lambda x: x["v"]).alias(out))
                elif kind == "$first":
                    outs.append(F.min_by(F.struct(value.alias("v")), F.col(ord_))["v"].alias(out))
            key = F.col(spec["_id"][1:]) if spec["_id"] else F.lit(None).cast("string")
            df = df.groupBy(key.alias("_key")).agg(*outs, F.min(ord_).alias("_first")).withColumnRenamed("_key", "_id")
            ord_, order = "_first", [F.col("_first")]
    return df.drop("_first") if ord_ == "_first" else df


def top_k(df: DataFrame, by: Column, k: int, ord_: str) -> DataFrame:
    """The k greatest, ties by insertion; a falsy k is no limit."""
    out = df.orderBy(by.desc_nulls_last(), F.col(ord_))
    return out.limit(k) if k else out


def page(df: DataFrame, number: int, size: int, ord_: str) -> DataFrame:
    """A 1-based page, with the number of pages by ceiling division."""
    total = df.agg(F.ceil(F.count("*") / size).cast("long").alias("total_pages"))
    return df.orderBy(ord_).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def keyset_page(df: DataFrame, cursor, size: int, key: str) -> DataFrame:
    """Rows after a cursor key; an unknown cursor starts again."""
    known = cursor is not None and df.where(F.col(key) == cursor).limit(1).count() > 0
    return (df.where(F.col(key) > cursor) if known else df).orderBy(key).limit(size)


def page_by_number(df: DataFrame, cursor: str | None, size: int, ord_: str) -> DataFrame:
    """A page from an integer cursor (none or no number: the start), with next_cursor ('' at the end)."""
    text = str(cursor or "").strip()
    start = max(0, int(text)) if text.lstrip("+-").isdigit() else 0
    total = df.agg(F.count("*").alias("_total"))
    after = F.when(F.col("_total") > start + size, F.lit(str(start + size))).otherwise(F.lit(""))
    return df.orderBy(ord_).offset(start).limit(size).crossJoin(F.broadcast(total)).withColumn("next_cursor", after).drop("_total")


def page_by_token(df: DataFrame, offset: str | None, max_records: int | None, page_size: int | None, ord_: str, cap: int = 100) -> DataFrame:
    """A page of the least of both sizes and the store's cap, with the token of the next one (null at the end)."""
    size = min(max_records or cap, page_size or cap, cap)
    out = page_by_number(df, offset, size, ord_)
    return out.withColumn("offset", F.nullif("next_cursor", F.lit(""))).drop("next_cursor")


def lookup(df: DataFrame, key: str, value, miss: str = "error", default: dict | None = None) -> DataFrame:
    """The row of a key.  Where there is none: an error when it is read, no row ('empty'), or a row of defaults ('default')."""
    row = df.where(F.col(key) == F.lit(value))
    if miss == "empty":
        return row
    one = df.sparkSession.range(1).select(F.lit(value).cast(df.schema[key].dataType).alias("_key"))
    both = one.join(row, F.col("_key") == F.col(key), "left")
    if miss == "error":
        found = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"no row for key {value!r}")).cast(df.schema[key].dataType)).otherwise(F.col(key))
        return both.select(*(found.alias(c) if c == key else F.col(c) for c in df.columns))
    values = {key: value, **(default or {})}
    there = F.col(key).isNotNull()
    return both.select(*(F.when(there, F.col(c)).otherwise(F.lit(values.get(c)).cast(df.schema[c].dataType)).alias(c) for c in df.columns))


def at_keys(df: DataFrame, columns: list[str], keys: list[str], separator: str = ":") -> DataFrame:
    """Rows whose columns, joined by the separator, are one of the keys; each column is compared by itself, so that scans can skip."""
    parts = [k.split(separator) for k in keys]
    wanted = [[F.lit(x).cast(df.schema[c].dataType) for c, x in zip(columns, p, strict=True)] for p in parts if len(p) == len(columns)]
    if not wanted:
        return df.limit(0)
    return df.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(columns, w, strict=True)]) for w in wanted]))


def coordinate_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.4f,%.4f", lat, lon)


def due_between(due: Column, low: str | None, high: str | None) -> Column:
    """Text dates inside the bounds, which count; no due date lets a row pass, as does no bound."""
    ok = F.lit(True)
    if low:
        ok = ok & (due >= low)
    if high:
        ok = ok & (due <= high)
    return due.isNull() | (due == "") | ok


def tagged_union(branches: dict[str, DataFrame], ord_: str, tag: str = "kind") -> DataFrame:
    """Rows of all branches with their tag, ordered by branch and then by each branch's order (columns _branch, ord_)."""
    return reduce(DataFrame.unionByName, [df.withColumns({tag: F.lit(name), "_branch": F.lit(k)}) for k, (name, df) in enumerate(branches.items())]).orderBy("_branch", ord_)


def entities(lists: DataFrame, key: str, ids: str, table: DataFrame, id_: str) -> DataFrame:
    """(key, position, table's columns) for the ids that a list names, in its order; ids that the table lacks are dropped."""
    named = lists.select(key, F.posexplode(ids).alias("position", id_))
    return named.join(table, id_).select(key, "position", *table.columns)


def index_search(index: DataFrame, key: str, ids: str, query: str, table: DataFrame, id_: str) -> DataFrame:
    """The table's rows that entries of an index (key, array ids) name, where the key holds the query; once for each entry."""
    return index.where(contains_any(query, key)).select(key, F.explode(ids).alias(id_)).join(table, id_)


def facets(df: DataFrame, keys: Column, default: str = "N/A") -> DataFrame:
    """(key, n) of every element of a list column; a missing list counts as the default, an empty one not at all."""
    return df.select(F.explode(F.coalesce(keys, F.array(F.lit(default)))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def mean_hours(df: DataFrame, by: list[str], start: Column, end: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Mean hours between two text times for each group; rows that do not parse are left out, a group without any has 0."""
    at = lambda c: F.unix_timestamp(F.try_to_timestamp(c, F.lit(form)))
    return df.groupBy(*by).agg(F.coalesce(F.avg((at(end) - at(start)) / 3600), F.lit(0.0)).alias("hours"))


def nested(df: DataFrame, outer: str, inner: str, value: str, ord_: str) -> DataFrame:
    """(outer, items): a map from inner to the list of values, in order."""
    lists = df.groupBy(outer, inner).agg(F.transform(F.sort_array(F.collect_list(F.struct(ord_, value))), lambda x: x[value]).alias("_v"))
    return lists.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(inner, "_v")))).alias("items"))


def first_zone(address: Column, zones: list[list[str]]) -> Column:
    """The 1-based number of the first zone one of whose names the address holds, else one more than there are."""
    out = None
    for k, names in enumerate(zones, 1):
        hit = reduce(lambda a, b: a | b, [F.contains(address, F.lit(x)) for x in names])
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(len(zones) + 1)


def zone_price(df: DataFrame, a: Column, b: Column, company: Column, weight: Column, rates: DataFrame, multipliers: DataFrame, rate: float = 10.0, multiplier: float = 1.5) -> DataFrame:
    """df with price and days: rate of the company x weight x multiplier of the unordered pair of zones.

    rates(company, rate), multipliers(zones 'low-high', multiplier); what they lack has the defaults, text that is no weight is 1."""
    rows = df.withColumns({"_a": a, "_b": b, "_company": company, "_weight": F.coalesce(F.try_to_number(weight, F.lit("999999999D999999")).cast("double"), F.lit(1.0))})
    rows = rows.withColumn("_zones", F.concat_ws("-", F.least("_a", "_b"), F.greatest("_a", "_b")))
    rows = rows.join(F.broadcast(rates.selectExpr("company _company", "rate _rate")), "_company", "left").join(F.broadcast(multipliers.selectExpr("zones _zones", "multiplier _multiplier")), "_zones", "left")
    price = F.bround(F.coalesce("_rate", F.lit(rate)) * F.col("_weight") * F.coalesce("_multiplier", F.lit(multiplier)), 2)
    days = F.when(F.col("_a") == F.col("_b"), 1).when(F.abs(F.col("_a") - F.col("_b")) <= 2, 2).otherwise(3)
    return rows.withColumns({"price": price, "days": days}).select(*df.columns, "price", "days")


def a1_range(sheet: DataFrame, range_: str | None, row: str = "row", cells: str = "cells") -> DataFrame:
    """Rows (0-based row, array cells) of a range in A1 notation with single letters; a range that is none gives all."""
    import re

    m = re.fullmatch(r"([A-Z])(\d+):([A-Z])(\d+)", range_ or "")
    if not m:
        return sheet
    first, last = ord(m[1]) - 65, ord(m[3]) - 65
    some = sheet.where(F.col(row).between(int(m[2]) - 1, int(m[4]) - 1))
    return some.withColumn(cells, F.slice(cells, first + 1, max(0, last - first + 1)))


def insert_documents(old: DataFrame, new: DataFrame, counter: int, key: str = "_id", ord_: str = "_ord") -> tuple[DataFrame, int]:
    """old and new rows; new ones without a key get gen_<counter> in their order.  Returns the next counter too."""
    from pyspark.sql import Window

    missing = new.where(F.col(key).isNull())
    n = missing.count()
    numbered = missing.withColumn(key, F.concat(F.lit("gen_"), (F.row_number().over(Window.orderBy(ord_)) - 1 + counter).cast("string")))  # one client's insert: small
    return old.unionByName(new.where(F.col(key).isNotNull())).unionByName(numbered), counter + n


def guarded_update(df: DataFrame, wanted: Column, guard: Column, changes: dict[str, Column], message: str) -> DataFrame:
    """df with the changes in the rows that are wanted; a wanted row that fails the guard is an error when it is read."""
    ok = F.when(guard, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.withColumns({c: F.when(wanted, F.when(ok, v)).otherwise(F.col(c)) for c, v in changes.items()})


#: Values of an approximate rank err by at most 1 / ACCURACY of all.
ACCURACY = 10_000


def floor_quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """sorted[n // 4], [n // 2], [3n // 4] for each key; not interpolated.

    Approximate ranks, whose error is bounded, enclose each quantile between two values; what is below
    is only counted, and the few rows between them are sorted."""
    from pyspark.sql import Window

    rows = df.select(F.col(key).alias("_k"), F.col(value).alias("_v")).where("_v is not null")
    at = [min(1.0, max(0.0, q / 4 + d * 2 / ACCURACY)) for q in (1, 2, 3) for d in (-1, 1)]
    edges = rows.groupBy("_k").agg(F.count("*").alias("_n"), F.percentile_approx("_v", at, ACCURACY).alias("_e")).withColumnRenamed("_k", "_at")
    met = rows.join(edges, F.col("_k").eqNullSafe(F.col("_at"))).select("_k", "_v", "_n", "_e")
    below = met.groupBy("_k").agg(*(F.count_if(F.col("_v") < F.col("_e")[2 * q]).alias(f"_b{q}") for q in range(3)))
    inside = F.filter(F.array(*(F.when(F.col("_v").between(F.col("_e")[2 * q], F.col("_e")[2 * q + 1]), F.lit(q)) for q in range(3))), lambda q: q.isNotNull())
    near = met.select("_k", "_v", "_n", F.explode(inside).alias("_q"))
    near = near.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_q").orderBy("_v")) - 1).join(below.withColumnRenamed("_k", "_key"), F.col("_k").eqNullSafe(F.col("_key")))
    hit = F.col("_i") == F.floor(F.col("_n") * (F.col("_q") + 1) / 4) - F.element_at(F.array("_b0", "_b1", "_b2"), F.col("_q") + 1)
    out = near.where(hit).groupBy("_k").agg(*(F.max(F.when(F.col("_q") == q, F.col("_v"))).alias(f"q{q + 1}") for q in range(3)))
    return out.withColumnRenamed("_k", key)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The new rows, and the old ones whose keys they lack."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def cascade_delete(parents: DataFrame, children: DataFrame, gone: Column, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the parents that match and what hangs on them."""
    dead = parents.where(gone).select(F.col(key).alias(foreign))
    return parents.where(~F.coalesce(gone, F.lit(False))), children.join(dead, foreign, "left_anti")


def found_missing(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each id with found true or false."""
    there = table.select(key).distinct().withColumn("found", F.lit(True))
    return ids.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def haversine(lat1, lon1, lat2, lon2, radius: float = 6371000.0) -> Column:
    """Metres between two points."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.lit(radius) * F.asin(F.sqrt(a))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Plane distance of two points in degrees."""
    return F.sqrt(F.pow(lat2 - lat1, F.lit(2)) + F.pow(lon2 - lon1, F.lit(2)))


def nearest(df: DataFrame, lat: Column, lon: Column, sites: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """df with nearest: the key of the nearest of sites(key, lat, lon) in the plane, the first by key among equals.

    Sites are a short list (at most `most`, else an error), which every row scans as a constant."""
    found = sites.orderBy(key).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} sites")
    if not found:
        return df.withColumn("nearest", F.lit(None).cast(sites.schema[key].dataType))
    listed = F.array(*(F.struct(F.lit(float(r["lat"])).alias("lat"), F.lit(float(r["lon"])).alias("lon"), F.lit(i).alias("i"), F.lit(r[key]).cast(sites.schema[key].dataType).alias("key")) for i, r in enumerate(found)))
    best = F.array_min(F.transform(listed, lambda s: F.struct(degrees_apart(lat, lon, s["lat"], s["lon"]).alias("d"), s["i"].alias("i"), s["key"].alias("key"))))
    return df.withColumn("nearest", best["key"])


def within(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Pairs of points(lat, lon, ...) and centres(c_lat, c_lon, ...) less than radius degrees apart.

    Points meet centres by cells as wide as the radius, of which a centre looks at nine; distances are then checked."""
    cell = lambda c, d=0: F.floor(c / radius).cast("long") + d
    nine = F.array(*(F.struct(cell(F.col("c_lat"), i).alias("_x"), cell(F.col("c_lon"), j).alias("_y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    near = centres.select("*", F.inline(nine))
    met = points.withColumns({"_x": cell(F.col("lat")), "_y": cell(F.col("lon"))}).join(near, ["_x", "_y"])
    return met.where(degrees_apart(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")) < radius).drop("_x", "_y")


def replay(calls: DataFrame, key: str, order: str) -> DataFrame:
    """State after each call (key, order, op, item, value) of a client: set, add, delete over a small map.

    One client's calls are folded in order; clients are independent."""
    schema = calls.select(key, order).schema.add("response", "string").add("size", "long").add("total", "double")

    def fold(pdf):
        import pandas as pd

        state, out = {}, []
        for r in pdf.sort_values(order).itertuples(index=False):
            if r.op == "delete":
                said = "deleted" if state.pop(r.item, None) is not None else "missing"
            else:
                said = "updated" if r.item in state else "created"
                state[r.item] = r.value + (state.get(r.item, 0.0) if r.op == "add" else 0.0)
            out.append((getattr(r, key), getattr(r, order), said, len(state), float(sum(state.values()))))
        return pd.DataFrame(out, columns=[key, order, "response", "size", "total"])

    return calls.groupBy(key).applyInPandas(fold, schema)
