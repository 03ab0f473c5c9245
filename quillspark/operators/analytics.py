"""Dashboards and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.access import User, accessible, accessible_base

SORTS = {
    "updated": lambda: [F.col("updated_at").desc(), F.col("id").desc()],
    "latest": lambda: [F.col("created_at").desc(), F.col("id").desc()],
    "hot": lambda: [F.col("popularity").desc(), F.col("id").desc()],
}


def with_popularity(docs: DataFrame, counters: DataFrame, likes: DataFrame) -> DataFrame:
    """Views, downloads, likes and popularity = views + 2 downloads + 3 likes. The counts
    are aggregated before the join, so no document row is multiplied."""
    liked = likes.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("likes"))
    out = docs.join(counters, "id", "left").join(liked, "id", "left").fillna(0, ["views", "downloads", "likes"])
    return out.withColumn("popularity", F.col("views") + 2 * F.col("downloads") + 3 * F.col("likes"))


def totals(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.coalesce(F.sum("downloads"), F.lit(0)).alias("downloads"))


def by_category(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), "category")


def hot_keywords(logs: DataFrame, user: User, k: int = 8) -> DataFrame:
    return logs.where(F.col("user_id") == user.id).groupBy("query").agg(F.count(F.lit(1)).alias("value")).orderBy(F.desc("value"), "query").limit(k)


def search_trend(logs: DataFrame, days: int = 14) -> DataFrame:
    """Searches per day on the latest ``days`` days that have any, in order."""
    daily = logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("value"))
    return daily.orderBy(F.desc("day")).limit(days).orderBy("day")


def listing(docs: DataFrame, sort: str = "updated", limit: int = 50) -> DataFrame:
    if sort not in SORTS or not 1 <= limit <= 100:
        raise ValueError("sort is updated, latest or hot; limit 1 to 100")
    return docs.orderBy(*SORTS[sort]()).limit(limit)


def in_given_order(docs: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of the ids, in the order of the list (T4)."""
    place = F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col("id").cast("long"))
    return docs.where(F.col("id").isin(ids)).orderBy(place, "id")


def base_counts(bases: DataFrame, links: DataFrame) -> DataFrame:
    """Bases with the number of documents linked, whoever may see those."""
    counted = links.groupBy("kb").agg(F.count("document_id").alias("documents"))
    return bases.join(counted, "kb", "left").fillna(0, ["documents"])


def base_inventory(docs: DataFrame, days: int = 30) -> DataFrame:
    """Per base its documents as numbered lines, latest first, and their number (C8). A row
    a line: a base may hold a third of all documents, so its list is never one value;
    ``"\n".join`` of a page of lines is what a reader is shown.

    A line's place is its rank in a stretch of ``days`` plus the documents of the base in
    later stretches, so no task holds a base. Documents without a time come last.
    """
    part = F.floor(F.unix_timestamp("created_at") / (86400 * days))
    d = docs.withColumn("__part", F.coalesce(part, F.lit(-(1 << 40))))
    sizes = d.groupBy("kb", "__part").agg(F.count(F.lit(1)).alias("__n"))
    later = Window.partitionBy("kb").orderBy(F.desc("__part"))
    sizes = sizes.select("kb", "__part", (F.sum("__n").over(later) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy("kb")).alias("documents"))
    inside = F.row_number().over(Window.partitionBy("kb", "__part").orderBy(F.col("created_at").desc_nulls_last(), F.desc("id")))
    j = d.withColumn("__rn", inside).join(sizes, ["kb", "__part"]).withColumn("place", (F.col("__rn") + F.col("__before")).cast("int"))
    return j.select("kb", F.col("id").alias("document_id"), "documents", "place", F.concat_ws(". ", F.col("place").cast("string"), "title").alias("line"))


def chunk_coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """chunks, indexed, stale and pending in one pass over a left join."""
    v = vectors.select("chunk_id", F.col("document_version").alias("__v"), F.col("stale").alias("__stale"))
    j = chunks.join(v, "chunk_id", "left")
    current = F.col("__v").isNotNull() & (F.col("__v") == F.col("document_version")) & (F.col("__stale") == 0)
    out = j.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(current).alias("indexed"), F.count_if(F.col("__v").isNotNull() & ~current).alias("stale"))
    return out.withColumn("pending", F.greatest(F.lit(0), F.col("chunks") - F.col("indexed")))


def structure_counts(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per document: chunks, embedded chunks and chapters; nulls and '' do not count."""
    e = vectors.select("chunk_id", F.col("chunk_id").alias("__e"))
    return chunks.join(e, "chunk_id", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count("__e").alias("embedded"), F.countDistinct(F.nullif(F.col("chapter"), F.lit(""))).alias("chapters")
    )


def toggled(events: DataFrame) -> DataFrame:
    """Pairs (user_id, document_id) switched an odd number of times."""
    return events.groupBy("user_id", "document_id").agg((F.count(F.lit(1)) % 2 == 1).alias("active")).where("active").select("user_id", "document_id")


def last_set(events: DataFrame) -> DataFrame:
    """Pairs whose latest event (by ts, event_id) sets the relation: (…, active)."""
    return events.groupBy("user_id", "document_id").agg(F.max_by("active", F.struct("ts", "event_id")).alias("active")).where("active").select("user_id", "document_id")


def share_state(requests: DataFrame) -> DataFrame:
    """Per document, the state after its requests (document_id, seq, action): request
    makes private or rejected pending; approve, reject and withdraw act on pending only (S19).

    Approval ends it: nothing acts on what is shared. Until then a document is pending
    where the last of its requests, rejections and withdrawals is a request, so what
    matters of each step is the last such one before it; no list of steps is gathered.
    """
    order = Window.partitionBy("document_id").orderBy("seq")
    turn = F.when(F.col("action").isin("request", "reject", "withdraw"), F.col("action"))
    r = requests.withColumn("__before", F.last(turn, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    acts = (F.col("__before") == "request") & F.col("action").isin("approve", "reject", "withdraw")
    got = r.groupBy("document_id").agg(
        F.bool_or(F.coalesce(acts, F.lit(False)) & (F.col("action") == "approve")).alias("shared"),
        F.max_by("action", F.when(F.col("action").isin("request", "reject", "withdraw"), F.col("seq"))).alias("last"),
        F.max_by("action", F.when(F.coalesce(acts, F.lit(False)) & (F.col("action") != "approve"), F.col("seq"))).alias("ended"),
    )
    state = F.when(F.col("shared"), "shared").when(F.col("last") == "request", "pending").when(F.col("ended") == "reject", "rejected").otherwise("private")
    return got.select("document_id", state.alias("state"))


def share_queue(docs: DataFrame, users: DataFrame) -> DataFrame:
    return docs.where(F.col("share_status") == "pending").join(users.select(F.col("id").alias("owner_id"), F.col("username").alias("owner")), "owner_id").orderBy("created_at", "id")


def user_overview(users: DataFrame, docs: DataFrame) -> DataFrame:
    owned = docs.groupBy(F.col("owner_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return users.join(owned, "id", "left").fillna(0, ["documents"])


def sessions_of(messages: DataFrame) -> DataFrame:
    """Sessions with their number of messages and last turn."""
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


def last_messages(messages: DataFrame, k: int = 8, chars: int | None = None) -> DataFrame:
    """The last ``k`` messages of each session in order; ``chars`` keeps their ends."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    out = messages.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")
    return out.withColumn("text", F.right("text", F.lit(chars))) if chars else out


def model_history(messages: DataFrame, k: int = 6, chars: int = 1000) -> DataFrame:
    """What a model is shown of each session: of the last ``k`` (2 to 10) messages that are
    not blank, the last ``chars`` characters, in order."""
    if not 2 <= k <= 10:
        raise ValueError("k is 2 to 10")
    return last_messages(messages.where(F.trim(F.coalesce("text", F.lit(""))) != ""), k, chars)


def visible_counts(bases: DataFrame, logs: DataFrame, user: User) -> DataFrame:
    """How many bases the user may see, and how often they searched (A2), in one row."""
    seen = bases.where(accessible_base(user)).agg(F.count(F.lit(1)).alias("bases"))
    return seen.crossJoin(logs.where(F.col("user_id") == user.id).agg(F.count(F.lit(1)).alias("searches")))  # one row each


def dashboard(docs: DataFrame, logs: DataFrame, user: User) -> dict[str, DataFrame]:
    """Everything on a user's dashboard, lazily; ``docs`` has counters and popularity."""
    seen = docs.where(accessible(user))
    return {
        "totals": totals(seen),
        "categories": by_category(seen),
        "keywords": hot_keywords(logs, user),
        "trend": search_trend(logs.where(F.col("user_id") == user.id)),
        "popular": seen.orderBy(F.desc("popularity"), F.desc("updated_at"), F.desc("id")).limit(8),
        "latest": seen.orderBy(F.desc("created_at"), F.desc("id")).limit(8),
    }


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table (A20), as one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionAll(one)
    return out
