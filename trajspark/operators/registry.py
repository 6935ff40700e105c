"""Store tools by name: name -> function of (state, arguments) to (state, rows).

A state is a dict of tables, each with an order column _ord; tools return new states and change
nothing in place.  Tools are built from the families of store.py; more are added with `tool`.
Arguments that a tool does not know are an error; missing ones take its defaults.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import arithmetic
from . import knowledge, store

State = dict[str, DataFrame]
TOOLS: dict[str, Callable[..., tuple[State, DataFrame]]] = {}
#: Calls that manage the state and are not offered.
HIDDEN = ("load_scenario", "save_scenario")


def tool(name: str):
    """Registers a function of (state, **arguments) to rows, or to (state, rows)."""

    def register(f):
        TOOLS[name] = f
        return f

    return register


def names(servers: list[str] | None = None) -> list[str]:
    """The registered tools, of some servers or of all."""
    return sorted(n for n in TOOLS if servers is None or n.split("-", 1)[0] in servers)


def call(name: str, state: State, arguments: dict | str) -> tuple[State, DataFrame]:
    """Runs a tool; arguments may be JSON text.  Unknown tools and arguments raise ValueError."""
    if name not in TOOLS:
        raise ValueError(f"no tool {name!r}")
    arguments = json.loads(arguments) if isinstance(arguments, str) else arguments
    known = inspect.signature(TOOLS[name]).parameters
    wrong = [a for a in arguments if a not in known or a == "state"]
    missing = [a for a, p in known.items() if a != "state" and p.default is p.empty and a not in arguments]
    if wrong or missing:
        raise ValueError(f"{name}: unknown arguments {wrong}, missing ones {missing}")
    out = TOOLS[name](state, **arguments)
    return out if isinstance(out, tuple) else (state, out)


def replay(state: State, calls: list[dict]) -> tuple[State, list[tuple[str, DataFrame | None]]]:
    """Runs calls (name, arguments) in order, and returns the last state with (error or '', rows) of each."""
    said = []
    for c in calls:
        try:
            state, rows = call(c["name"], state, c.get("arguments", {}))
            said.append(("", rows))
        except ValueError as e:
            said.append((f"{c['name']} error: {e}", None))
    return state, said


# ---- families


def _given(**filters) -> dict:
    return {k: v for k, v in filters.items() if v is not None}


def scan(name: str, table: str) -> None:
    tool(name)(lambda state: state[table].orderBy("_ord"))


def by_key(name: str, table: str, key: str, argument: str | None = None, miss: str = "error", default: dict | None = None) -> None:
    """A lookup by one key, under the argument's own name."""

    def run(state, **value):
        (v,) = value.values()
        return store.lookup(state[table], key, v, miss, default)

    run.__signature__ = inspect.Signature([inspect.Parameter("state", inspect.Parameter.POSITIONAL_OR_KEYWORD), inspect.Parameter(argument or key, inspect.Parameter.KEYWORD_ONLY)])
    tool(name)(run)


def _put(state: State, table: str, row: dict, key: str) -> State:
    """The row added to a table, in place of the one with its key."""
    old = state[table]
    spark = old.sparkSession
    last = old.agg(F.coalesce(F.max("_ord"), F.lit(-1))).first()[0]
    values = {**row, "_ord": last + 1}
    new = spark.createDataFrame([tuple(values.get(c) for c in old.columns)], old.schema)
    return {**state, table: store.upsert(old, new, key)}


def _said(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


# ---- documents


@tool("MongoDBServer-list_databases")
def list_databases(state):
    return state["databases"].orderBy("_ord")


@tool("MongoDBServer-list_collections")
def list_collections(state, database):
    return state["collections"].where(F.col("database") == database).orderBy("_ord")


def _documents(state: State, database: str, collection: str) -> DataFrame:
    return state["documents"].where(F.col("key") == f"{database}.{collection}").drop("key")


@tool("MongoDBServer-find")
def find(state, database, collection, filter=None, projection=None, sort=None, limit=10, skip=0):  # noqa: A002
    df = _documents(state, database, collection)
    shown, hidden = ([c for c, on in (projection or {}).items() if bool(on) == want] for want in (True, False))
    out = store.find(df, filter, list((sort or {}).items()), limit, skip, None, None, "_ord")
    if shown:  # what is asked for wins; _id only if it is asked for
        return out.select(*[c for c in shown if c in out.columns])
    return out.drop("_ord", *hidden)


@tool("MongoDBServer-aggregate")
def aggregate(state, database, collection, pipeline):
    return store.aggregate(_documents(state, database, collection), pipeline, "_ord")


@tool("MongoDBServer-insert_one")
def insert_one(state, database, collection, document):
    old = state["documents"]
    spark = old.sparkSession
    counter = state.get("next_id_counter") if state.get("next_id_counter") is not None else _said(spark, next_id_counter=1)
    n = counter.first()[0]
    key = document.get("_id") or f"gen_{n}"
    last = old.agg(F.coalesce(F.max("_ord"), F.lit(-1))).first()[0]
    values = {**document, "_id": key, "key": f"{database}.{collection}", "_ord": last + 1}
    new = spark.createDataFrame([tuple(values.get(c) for c in old.columns)], old.schema)
    out = {**state, "documents": old.unionByName(new), "next_id_counter": _said(spark, next_id_counter=n + ("_id" not in document))}
    return out, _said(spark, acknowledged=True, inserted_id=str(key))


# ---- knowledge graph: entities(name, kind, observations), relations(source, target, kind)


def _rows(like: DataFrame, rows: list[dict]) -> DataFrame:
    return like.sparkSession.createDataFrame([tuple(r.get(c) for c in like.columns) for r in rows], like.schema)


@tool("MemoryKnowledgeGraph-create_entities")
def create_entities(state, entities):
    new = _rows(state["entities"], [{"name": e["name"], "kind": e["entityType"], "observations": e.get("observations", [])} for e in entities])
    fresh = new.join(state["entities"].select("name"), "name", "left_anti")
    return {**state, "entities": knowledge.add_entities(state["entities"], new)}, fresh


@tool("MemoryKnowledgeGraph-create_relations")
def create_relations(state, relations):
    new = _rows(state["relations"], [{"source": r["from"], "target": r["to"], "kind": r["relationType"]} for r in relations])
    ends = state["entities"].select("name")
    known = new.join(ends.withColumnRenamed("name", "source"), "source", "left_semi").join(ends.withColumnRenamed("name", "target"), "target", "left_semi").select(*new.columns)
    fresh = known.subtract(state["relations"])
    return {**state, "relations": knowledge.add_relations(state["relations"], known)}, fresh


@tool("MemoryKnowledgeGraph-add_observations")
def add_observations(state, observations):
    flat = [(o["entityName"], x, i) for o in observations for i, x in enumerate(o["contents"])]
    new = state["entities"].sparkSession.createDataFrame(flat, "name string, observation string, ord int")
    after = knowledge.add_observations(state["entities"], new)
    return {**state, "entities": after}, after.join(new.select("name").distinct(), "name", "left_semi")


@tool("MemoryKnowledgeGraph-search_nodes")
def search_nodes(state, query):
    return knowledge.search_nodes(state["entities"], state["relations"], query)[0]


@tool("MemoryKnowledgeGraph-open_nodes")
def open_nodes(state, names):
    return knowledge.open_nodes(state["entities"], state["relations"], names)[0]


# ---- calculator


@tool("Calculator-calculate")
def calculate(state, expression):
    history = state["history"]
    row = history.sparkSession.range(1).select(F.lit(expression).alias("expression"), arithmetic(expression.replace("math.", "")).alias("result"))
    return {**state, "history": history.unionByName(row, allowMissingColumns=True)}, row


# ---- accounts, weather, articles, flights: lookups and filters


for _name, _table, _key, _argument, _miss, _default in (
    ("CampusCard-query_balance", "accounts", "userId", None, "error", None),
    ("Weather-get_current_weather_at", "current_weather", "coordinates", None, "empty", None),
    ("Weather-search_location", "city_database", "city", None, "empty", None),
    ("Weather-get_saved_location", "saved_locations", "alias", None, "empty", None),
    ("PubMedServer-get_pubmed_article", "articles", "pmid", None, "empty", None),
    ("Airline-get_flight_status", "flight_statuses", "flight_number", None, "empty", None),
    ("Airline-get_user_details", "users", "user_id", None, "empty", None),
    ("Airline-get_reservation_details", "reservations", "reservation_id", None, "empty", None),
    ("Dice-get_job_details", "jobs", "job_id", None, "empty", None),
    ("Maps-maps_place_details", "places", "place_id", None, "empty", None),
    ("Kuaidi100-query_trace", "tracking_records", "kuaidi_num", None, "default", {"kuaidi_company": "unknown"}),
    ("FinancialDatasets-get_current_stock_price", "stock_prices", "symbol", None, "default", {"price": 0.0, "currency": "USD", "change": 0.0, "change_percent": 0.0}),
    ("TicketManagementSystem-get_ticket", "tickets", "ticket_id", None, "empty", None),
):
    by_key(_name, _table, _key, _argument, _miss, _default)
for _name, _table in (("Airline-list_airports", "airports"), ("Weather-list_saved_locations", "saved_locations")):
    scan(_name, _table)


@tool("CampusCard-query_transactions")
def query_transactions(state, userId, startDate=None, endDate=None):  # noqa: N803
    rows = state["transactions"].where(F.col("userId") == userId)
    return rows.where(store.due_between(F.col("date"), startDate, endDate)).orderBy("_ord")


@tool("CampusCard-recharge")
def recharge(state, userId, amount):  # noqa: N803
    rows = state["accounts"].withColumn("balance", F.when(F.col("userId") == userId, F.col("balance") + float(amount)).otherwise(F.col("balance")))
    return {**state, "accounts": rows}, store.lookup(rows, "userId", userId)


@tool("Weather-get_current_weather")
def current_weather(state, latitude, longitude):
    return state["current_weather"].where(F.col("coordinates") == f"{latitude:.4f},{longitude:.4f}")


@tool("Weather-get_alerts")
def alerts(state, latitude, longitude, active_only=True):
    rows = state["alerts"].where(F.col("coordinates") == f"{latitude:.4f},{longitude:.4f}")
    return rows.where("active") if active_only else rows


@tool("Weather-get_historical_weather")
def historical_weather(state, latitude, longitude, start_date, end_date, limit=10):
    rows = state["historical_records"].where((F.col("coordinates") == f"{latitude:.4f},{longitude:.4f}") & F.col("date").between(start_date, end_date)).orderBy("_ord")
    return rows.limit(limit) if limit else rows


@tool("Weather-save_location")
def save_location(state, alias, latitude, longitude, name):
    after = _put(state, "saved_locations", {"alias": alias, "latitude": float(latitude), "longitude": float(longitude), "name": name}, "alias")
    return after, store.lookup(after["saved_locations"], "alias", alias)


@tool("Weather-remove_saved_location")
def remove_saved_location(state, alias):
    rows = state["saved_locations"]
    return {**state, "saved_locations": rows.where(F.col("alias") != alias)}, rows.where(F.col("alias") == alias)


@tool("PubMedServer-fetch_pubmed_articles")
def fetch_articles(state, pmids):
    ids = state["articles"].sparkSession.createDataFrame([(p,) for p in pmids], "pmid string")
    return store.found_missing(ids, state["articles"], "pmid")


@tool("PubMedServer-search_pubmed_by_author")
def by_author(state, author, max_results=10):
    said = F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(author.lower())))
    return state["articles"].where(said).orderBy("_ord").limit(max_results)


@tool("PubMedServer-search_pubmed_by_journal")
def by_journal(state, journal, year=None, max_results=10):
    rows = state["articles"].where(store.contains_any(journal, "journal"))
    return (rows if year is None else rows.where(F.col("publication_date").startswith(str(year)))).orderBy("_ord").limit(max_results)


@tool("Airline-search_flights")
def search_flights(state, origin, destination):
    return state["flights"].where((F.col("origin") == origin) & (F.col("destination") == destination)).orderBy("_ord")


@tool("Airline-cancel_reservation")
def cancel_reservation(state, reservation_id):
    rows = state["reservations"]
    return {**state, "reservations": rows.where(F.col("reservation_id") != reservation_id)}, store.lookup(rows, "reservation_id", reservation_id)


# ---- jobs


def _near(rows: DataFrame, location: str | None) -> DataFrame:
    return rows if not location else rows.where(store.contains_any(location, "location"))


@tool("Dice-search_tech_jobs")
def search_jobs(state, keywords, location=None, remote_only=False):
    rows = _near(state["jobs"].where(store.contains_any(keywords, "title", "company")), location)
    return (rows.where("is_remote") if remote_only else rows).orderBy("_ord")


@tool("Dice-search_by_skills")
def search_skills(state, skills, location=None):
    wanted = F.array(*(F.lit(s.lower()) for s in skills))
    share = F.size(F.array_intersect(wanted, F.transform("skills", F.lower))) / float(max(1, len(skills)))
    return _near(state["jobs"], location).withColumn("match", share).where("match > 0").orderBy(F.desc("match"), "_ord")


@tool("Dice-get_salary_insights")
def salary_insights(state, job_title, location=None):
    rows = _near(state["jobs"].where(store.contains_any(job_title, "title")), location)
    return store.floor_quantiles(rows.select(F.lit(job_title).alias("title"), ((F.col("salary_min") + F.col("salary_max")) / 2).alias("salary")), "title", "salary")


@tool("Dice-get_tech_trends")
def tech_trends(state):
    skills = state["jobs"].select(F.explode("skills").alias("skill"), ((F.col("salary_min") + F.col("salary_max")) / 2).alias("salary"))
    return skills.groupBy("skill").agg(F.count("*").alias("n"), F.avg("salary").alias("salary")).orderBy(F.desc("n"), "skill").limit(10)


# ---- tickets


def _tickets(state: State, **filters) -> DataFrame:
    rows = state["tickets"]
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), _given(**filters).items(), rows).orderBy("_ord")


@tool("TicketManagementSystem-list_tickets")
def list_tickets(state, status=None, priority=None, category=None, assignee=None, limit=5, offset=0):
    return _tickets(state, status=status, priority=priority, category=category, assignee=assignee).offset(offset).limit(limit)


@tool("TicketManagementSystem-search_tickets")
def search_tickets(state, query, status=None, limit=5):
    return _tickets(state, status=status).where(store.contains_any(query, "title", "description")).orderBy("_ord").limit(limit)


@tool("TicketManagementSystem-get_user_tickets")
def user_tickets(state, username=None, status=None, limit=5):
    return _tickets(state, created_by=username, status=status).limit(limit)


def _change(state: State, ticket_id, guard: Column, changes: dict[str, Column], message: str) -> tuple[State, DataFrame]:
    rows = store.guarded_update(state["tickets"], F.col("ticket_id") == ticket_id, guard, changes, message)
    return {**state, "tickets": rows}, store.lookup(rows, "ticket_id", ticket_id)


@tool("TicketManagementSystem-close_ticket")
def close_ticket(state, ticket_id):
    return _change(state, ticket_id, F.col("status") != "closed", {"status": F.lit("closed")}, "the ticket is closed")


@tool("TicketManagementSystem-resolve_ticket")
def resolve_ticket(state, ticket_id, resolution):
    return _change(state, ticket_id, ~F.col("status").isin("resolved", "closed"), {"status": F.lit("resolved"), "resolution": F.lit(resolution)}, "the ticket is resolved")


@tool("TicketManagementSystem-get_ticket_statistics")
def ticket_statistics(state):
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("open", "in_progress", "resolved", "closed")]
    hours = store.mean_hours(state["tickets"].where("status = 'resolved' and length(resolution) > 0"), [], F.col("created_at"), F.col("updated_at"))
    return state["tickets"].agg(F.count("*").alias("total"), *counts).crossJoin(hours)  # one row each


# ---- messages, parcels, maps


@tool("SlackServer-channels_list")
def channels(state, channel_types, sort=None, limit=100, cursor=None):
    rows = state["channels"].where(store.csv_in("type", channel_types))
    if sort == "popularity":
        # the cursor counts rows of this order
        rows = rows.orderBy(F.desc("num_members"), "_ord").offset(int(cursor) if str(cursor or "").isdigit() else 0).limit(limit)
        return rows
    return store.page_by_number(rows, cursor, limit, "_ord")


@tool("Kuaidi100-estimate_price")
def estimate_price(state, kuaidi_company, from_addr, to_addr, weight="1.0"):
    zones = [[r["name"] for r in state["zones"].where(F.col("zone") == z).orderBy("_ord").collect()] for z in range(1, 5)]  # a fixed table of provinces
    one = _said(state["rates"].sparkSession, company=kuaidi_company, weight=weight, a=from_addr, b=to_addr)
    return store.zone_price(one, store.first_zone(F.col("a"), zones), store.first_zone(F.col("b"), zones), F.col("company"), F.col("weight"), state["rates"], state["multipliers"])


@tool("Maps-maps_reverse_geocode")
def reverse_geocode(state, latitude, longitude):
    one = _said(state["cities"].sparkSession, latitude=float(latitude), longitude=float(longitude))
    near = store.nearest(one, F.col("latitude"), F.col("longitude"), state["cities"].selectExpr("city", "latitude lat", "longitude lon"), "city")
    return near.withColumn("nearest", F.coalesce("nearest", F.lit("Unknown Location"))).withColumn("formatted_address", F.concat("nearest", F.lit(f" ({latitude:.4f}, {longitude:.4f})")))


# ---- tools by rule, from metadata

READS, LISTS, SEARCHES, DELETES = ("get", "query", "fetch", "lookup", "show"), ("list", "get_all"), ("search", "find"), ("delete", "remove", "cancel")


def by_rule(metadata: list[dict], keys: dict[str, str]) -> dict[str, Callable[..., tuple[State, DataFrame]]]:
    """Tools that metadata (class_name, tools with name and input_schema) describes and a rule can build, by name.

    keys gives the key column of each table of the state.  A tool that lists and needs no argument scans the table that its
    name ends with; one that reads, or deletes, by the single argument that is some table's key looks it up, or
    drops it; one that searches by a single text looks for it in all text columns of the table that its name
    ends with.  Other tools are not built; built ones are registered with `tool` by the caller."""
    built: dict[str, Callable[..., tuple[State, DataFrame]]] = {}
    for server in metadata:
        for t in server["tools"]:
            name, schema = t["name"], t.get("input_schema") or {}
            needed = schema.get("required") or []
            verb = lambda verbs: any(name == v or name.startswith(f"{v}_") for v in verbs)  # noqa: B023, E731
            named = [x for x in keys if name.endswith(f"_{x}")]
            keyed = [x for x, k in keys.items() if needed == [k]]
            full = f"{server['class_name']}-{name}"
            if verb(LISTS) and not needed and len(named) == 1:
                built[full] = lambda state, table=named[0]: state[table].orderBy("_ord")
            elif verb(SEARCHES) and len(needed) == 1 and len(named) == 1:
                built[full] = _searching(named[0], needed[0])
            elif verb(READS) and len(keyed) == 1:
                built[full] = _keyed(keyed[0], needed[0], lambda state, table, rows, _: (state, rows))
            elif verb(DELETES) and len(keyed) == 1:
                built[full] = _keyed(keyed[0], needed[0], lambda state, table, rows, rest: ({**state, table: rest}, rows))
    return built


def _signed(run: Callable, argument: str) -> Callable:
    run.__signature__ = inspect.Signature([inspect.Parameter("state", inspect.Parameter.POSITIONAL_OR_KEYWORD), inspect.Parameter(argument, inspect.Parameter.KEYWORD_ONLY)])
    return run


def _keyed(table: str, key: str, then: Callable) -> Callable:
    def run(state, **value):
        hit = F.col(key) == F.lit(value[key])
        return then(state, table, state[table].where(hit), state[table].where(~F.coalesce(hit, F.lit(False))))

    return _signed(run, key)


def _searching(table: str, argument: str) -> Callable:
    def run(state, **value):
        rows = state[table]
        texts = [f.name for f in rows.schema.fields if f.dataType.typeName() == "string"]
        return rows.where(store.contains_any(str(value[argument]), *texts)).orderBy("_ord") if texts else rows.limit(0)

    return _signed(run, argument)


def current_datetime(spark: SparkSession) -> DataFrame:
    """The helper that tells an agent the time: one row, in the session's zone."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("now"))
