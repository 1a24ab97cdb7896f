"""Entity tables from property events.

A property log holds ``$set`` / ``$unset`` / ``$delete`` events per entity.
Folding it in time order gives each entity's current properties; an entity
exists when it has a ``$set`` after its last ``$delete``.

The fold reads its log once. An event is a row of its own and a row per property;
the latest row of each (entity, property) is kept by a partial and a final
aggregation, so a hot entity is combined map-side instead of landing whole in
one task, and a second aggregation of these reduced rows gathers each entity.
The latest rows are mergeable (``FoldState``), so a stored snapshot plus the
events since equals a full fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.config import CONTENT, COSMETIC
from affinity.session import stage

SET, UNSET, DELETE = "$set", "$unset", "$delete"


_KEYS = ["entity_type", "entity_id"]
#: What a row of the fold is about: a property (named by ``key``), or the entity's own $set or $delete events.
_PROPERTY, _SET, _DELETE = 0, 1, 2


@dataclass(frozen=True)
class FoldState:
    """What a fold needs of the events so far; states of disjoint event sets merge to the state of all.

    ``latest``: (entity_type, entity_id, mark, key, last), the latest $set or $unset of
    each key, and the latest $set and $delete of each entity (key null).
    """

    latest: DataFrame

    def staged(self) -> FoldState:
        """The state as a written table: the snapshot that the next events are merged into."""
        return FoldState(stage(self.latest, "fold_state"))


def _events_of(prop_log: DataFrame, entity_type: str | tuple[str, ...] | None) -> DataFrame:
    if entity_type is not None:
        types = (entity_type,) if isinstance(entity_type, str) else entity_type
        prop_log = prop_log.filter(F.col("entity_type").isin(*types))
    return prop_log.filter(F.col("event").isin(SET, UNSET, DELETE))


def _latest(rows: DataFrame) -> FoldState:
    return FoldState(rows.groupBy(*_KEYS, "mark", "key").agg(F.max("last").alias("last")))


def fold_state(prop_log: DataFrame, entity_type: str | tuple[str, ...] | None = None) -> FoldState:
    log = _events_of(prop_log, entity_type)
    event, text = F.col("event"), F.lit(None).cast("string")
    row = lambda mark, key, value: F.struct(F.lit(mark).alias("mark"), key.alias("key"), value.alias("value"))
    rows = "array<struct<mark:int,key:string,value:string>>"
    touched = F.coalesce(F.transform(F.map_entries("properties"), lambda e: row(_PROPERTY, e["key"], e["value"])), F.array().cast(rows))
    own = lambda mark: F.array(row(mark, text, text))
    each = (F.when(event == DELETE, own(_DELETE).cast(rows)).when(event == SET, F.concat(own(_SET).cast(rows), touched.cast(rows)))
            .otherwise(touched.cast(rows)))
    told = log.select(*_KEYS, "ts", "event_id", (event == SET).alias("is_set"), F.inline(each))
    return _latest(told.select(*_KEYS, "mark", "key", F.struct("ts", "event_id", "is_set", "value").alias("last")))


def merge_fold_states(a: FoldState, b: FoldState) -> FoldState:
    """The state of both event sets, in whatever order they came: a snapshot and what arrived since."""
    return _latest(a.latest.unionByName(b.latest))


def _alive(last_set, last_delete):
    """An entity exists when it has a $set after its last $delete."""
    return last_set.isNotNull() & (last_delete.isNull() | (last_set > last_delete))


def fold_properties(state: FoldState) -> DataFrame:
    """Current properties per surviving entity: (entity_type, entity_id, properties map)."""
    mark, at = F.col("mark"), F.struct(F.col("last.ts").alias("ts"), F.col("last.event_id").alias("event_id"))
    # an $unset has done its work once it is the latest of its key
    rows = state.latest.filter((mark != _PROPERTY) | F.col("last.is_set"))
    entities = rows.groupBy(*_KEYS).agg(
        F.max(F.when(mark == _SET, at)).alias("last_set"), F.max(F.when(mark == _DELETE, at)).alias("last_delete"),
        F.collect_list(F.when(mark == _PROPERTY, F.struct("key", F.col("last.value").alias("value"), at.alias("at")))).alias("kept"))
    kept = F.filter("kept", lambda x: F.col("last_delete").isNull() | (x["at"] > F.col("last_delete")))
    properties = F.map_from_entries(F.transform(kept, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    # nothing names the properties of an entity without an id
    named = F.col("entity_type").isNotNull() & F.col("entity_id").isNotNull()
    return (entities.filter(_alive(F.col("last_set"), F.col("last_delete")))
            .select(*_KEYS, F.when(named, properties).otherwise(F.create_map().cast("map<string,string>")).alias("properties")))


def surviving_entities(prop_log: DataFrame, entity_type: str | None = None) -> DataFrame:
    """The entities of ``property_fold`` without their properties: (entity_type, entity_id)."""
    at = F.struct("ts", "event_id")
    latest = _events_of(prop_log, entity_type).groupBy(*_KEYS).agg(
        F.max(F.when(F.col("event") == SET, at)).alias("last_set"), F.max(F.when(F.col("event") == DELETE, at)).alias("last_delete"))
    return latest.filter(_alive(F.col("last_set"), F.col("last_delete"))).select(*_KEYS)


def property_fold(prop_log: DataFrame, entity_type: str | tuple[str, ...] | None = None) -> DataFrame:
    """Current properties per surviving entity: (entity_type, entity_id, properties map)."""
    return fold_properties(fold_state(prop_log, entity_type))


def users_view(folded_users: DataFrame) -> DataFrame:
    """The users table is the surviving user ids."""
    return folded_users.select(F.col("entity_id").alias("user_id"))


def items_view(folded: DataFrame) -> DataFrame:
    """Content entities (cosmetics and upload_date optional) and cosmetic entities (categories and brand optional)."""
    p, kind = F.col("properties"), F.col("entity_type")
    texts = lambda name: F.from_json(p[name], "array<string>")
    return folded.select(
        F.col("entity_id").alias("item_id"), kind.alias("item_type"),
        F.when(kind == COSMETIC, texts("categories")).alias("categories"), F.when(kind == COSMETIC, _json_string(p["brand"])).alias("brand"),
        F.when(kind == CONTENT, F.array_distinct(texts("cosmetics"))).alias("cosmetics"),
        F.when(kind == CONTENT, _json_string(p["upload_date"])).alias("upload_date"))


def _json_string(c):
    """A property value holds JSON text; a JSON string is unquoted, others kept as text."""
    return F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")).otherwise(c)


def items_from_properties(prop_log: DataFrame) -> DataFrame:
    """items = content view UNION ALL cosmetic view, of one fold of both kinds."""
    return items_view(property_fold(prop_log, (CONTENT, COSMETIC)))


def duplicate_item_ids(items: DataFrame) -> DataFrame:
    """Q11: ids present more than once (an id must name one item)."""
    return items.groupBy("item_id").count().filter(F.col("count") > 1)


def require_unique_items(items: DataFrame) -> None:
    if not duplicate_item_ids(items).isEmpty():
        raise ValueError("item ids must be unique across content and cosmetic")
