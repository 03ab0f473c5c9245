"""Who may see what: predicates that Catalyst pushes to the scans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADMINS = ("department_admin", "system_admin")


@dataclass(frozen=True)
class User:
    id: int
    role: str = "user"

    @property
    def sees_all(self) -> bool:
        return self.role in ADMINS


def accessible(user: User, write: bool = False, prefix: str = "") -> Column:
    """Admins see all, others what they own or what is shared; to write, only the former."""
    if user.sees_all:
        return F.lit(True)
    owned = F.col(f"{prefix}owner_id") == user.id
    return owned if write else owned | (F.col(f"{prefix}share_status") == "shared")


def accessible_base(user: User, write: bool = False, prefix: str = "") -> Column:
    """Knowledge bases: visibility is apart from the documents in them."""
    if user.sees_all:
        return F.lit(True)
    owned = F.col(f"{prefix}owner_id") == user.id
    return owned if write else owned | F.col(f"{prefix}visibility").isin("shared", "public")


def matching(ids: list[int] | None = None, category: str | None = None, tag: str | None = None, chapter: str | None = None, status: str | None = None, id_col: str = "id") -> Column:
    """The conjunction of the filters given. An empty list of ids filters nothing;
    a list without one valid id matches nothing."""
    out = F.lit(True)
    if ids:
        valid = [i for i in ids if isinstance(i, int) and 0 < i < 2**53]
        out &= F.col(id_col).isin(valid) if valid else F.lit(False)
    for name, value in (("category", category), ("chapter", chapter), ("share_status", status)):
        if value:
            out &= F.col(name) == value
    if tag:
        out &= F.array_contains("tags", tag)
    return out


def in_scope(docs: DataFrame, user: User, scope: str, favorites: DataFrame) -> DataFrame:
    """all, mine, favorites or shared, of what the user may see."""
    docs = docs.where(accessible(user))
    if scope == "mine":
        return docs.where(F.col("owner_id") == user.id)
    if scope == "shared":
        return docs.where(F.col("share_status") == "shared")
    if scope == "favorites":
        mine = favorites.where(F.col("user_id") == user.id).select(F.col("document_id").alias("id"))
        return docs.join(mine, "id", "left_semi")
    if scope != "all":
        raise ValueError(f"no such scope: {scope}")
    return docs


def in_bases(docs: DataFrame, links: DataFrame, bases: list[int]) -> DataFrame:
    """Documents linked to one of the bases, through (kb_id, document_id)."""
    return docs.join(links.where(F.col("kb_id").isin(bases)).select(F.col("document_id").alias("id")), "id", "left_semi")


def valid_sessions(sessions: DataFrame, now: Column | None = None) -> DataFrame:
    return sessions.where(F.col("expires_at") > (F.current_timestamp() if now is None else now))


def duplicate_identifiers(users: DataFrame, wanted: list[str]) -> DataFrame:
    """Users one of whose names, mails or phones is among ``wanted``."""
    named = users.withColumn("__id", F.explode(F.array_distinct(F.array("username", "email", "phone"))))
    return named.where(F.col("__id").isin(wanted)).drop("__id").distinct()


def hidden_when_revoked(messages: DataFrame, accessible_ids: DataFrame) -> DataFrame:
    """Assistant messages (message_id, role, content, cited array<long>) that cite a
    document no longer accessible lose their content and citations (F17)."""
    cited = messages.select("message_id", F.explode("cited").alias("id")).join(accessible_ids.select("id", F.lit(True).alias("ok")), "id", "left")
    lost = cited.groupBy("message_id").agg(F.bool_or(F.col("ok").isNull()).alias("lost"))
    hide = (F.col("role") == "assistant") & F.coalesce("lost", F.lit(False))
    out = messages.join(lost, "message_id", "left")
    return out.withColumn("content", F.when(hide, F.lit(None)).otherwise(F.col("content"))).withColumn("cited", F.when(hide, F.array().cast("array<long>")).otherwise(F.col("cited"))).withColumn("revoked", hide).drop("lost")


def shown(docs: DataFrame) -> DataFrame:
    """Documents as callers see them (F15): without the stored path and the text, tags as
    an array (empty where they are malformed), favourite and liked as booleans."""
    kinds = dict(docs.dtypes)
    tags = F.coalesce(F.from_json("tags", "array<string>") if kinds.get("tags") == "string" else F.col("tags"), F.array().cast("array<string>")) if "tags" in kinds else None
    out = docs.drop("stored_path", "text_content", "text")
    out = out if tags is None else out.withColumn("tags", tags)
    return out.withColumns({c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("favorite", "liked") if c in kinds})
