"""Tag algebra, rule collections and their incremental membership."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.catalog import in_set

MAX_GROUPS, MAX_VALUES = 16, 64


def effective_tags(sources: DataFrame, masks: DataFrame, valid_ai: DataFrame) -> DataFrame:
    """(asset_id, tag_key): distinct sources without masked pairs; an ``ai`` source counts only where the asset's result is valid."""
    ok = sources.where("source <> 'ai'").select("asset_id", "tag_key").unionByName(sources.where("source = 'ai'").join(valid_ai.select("asset_id"), "asset_id", "left_semi").select("asset_id", "tag_key"))
    return ok.join(masks.select("asset_id", "tag_key"), ["asset_id", "tag_key"], "left_anti").distinct()


def tag_usage(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_key").agg(F.count(F.lit(1)).alias("n_assets"))


def tag_search(tags: DataFrame, text: str, limit: int) -> DataFrame:
    """Tags whose folded name contains the text, most used first."""
    return tags.where(F.lower(F.col("name_folded")).contains(text.strip().lower())).orderBy(F.col("use_count").desc(), "id").limit(limit)


# What a rule may name, and how long a tag's name may be.
COLORS, LIKES, LOCKS = ("red", "yellow", "green", "cyan", "blue", "purple", "none"), ("like", "dislike", "none"), (0, 1, 2)
MAX_TAG_CHARS = 64


def tag_key(name: str) -> str:
    """A tag's key: its name without blanks at the ends, composed, in lower case; raises on none and on more than 64 characters."""
    n = name.strip()
    if not n or len(n) > MAX_TAG_CHARS:
        raise ValueError(f"a tag needs 1 to {MAX_TAG_CHARS} characters")
    return unicodedata.normalize("NFC", n).lower()


@dataclass(frozen=True)
class Group:
    """One conjunction of a rule; repositories are required, an empty dimension doesn't constrain."""

    repositories: tuple[str, ...]
    min_rating: int | None = None
    colors: tuple[str, ...] = ()
    likes: tuple[str, ...] = ()
    locks: tuple[int, ...] = ()
    tag_keys: tuple[str, ...] = ()

    def column(self) -> Column:
        c = [F.col("repository_id").isin(list(self.repositories))]
        if self.min_rating is not None:
            c.append(F.col("rating") >= self.min_rating)
        c += [in_set(F.col(n), list(v)) for n, v in (("color_label", self.colors), ("like_state", self.likes), ("lock_level", self.locks)) if v]
        if self.tag_keys:
            c.append(F.coalesce(F.arrays_overlap("__tags", F.array(*map(F.lit, self.tag_keys))), F.lit(False)))
        return reduce(lambda a, b: a & b, c)


def canonical_rule(groups: list[Group]) -> list[Group]:
    """Sorted, without repeats; no group is a collection without a rule.

    Raises on more than 16 groups, a group without repositories or with a blank one, more than 64
    repositories or tag keys, and on ratings, colours, likes and locks there are not.
    """
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"at most {MAX_GROUPS} groups")
    out = set()
    for g in groups:
        repositories = tuple(sorted({r.strip() for r in g.repositories}))
        if not repositories or "" in repositories:
            raise ValueError("each group needs its repositories")
        if g.min_rating is not None and not 0 <= g.min_rating <= 5:
            raise ValueError("a rating is 0 to 5")
        for values, known in ((g.colors, COLORS), (g.likes, LIKES), (g.locks, LOCKS)):
            if not set(values) <= set(known):
                raise ValueError(f"unknown values {sorted(set(values) - set(known), key=str)}")
        keys = tuple(sorted({tag_key(k) for k in g.tag_keys}))
        if max(len(repositories), len(keys)) > MAX_VALUES:
            raise ValueError(f"at most {MAX_VALUES} repositories and tags a group")
        out.add(Group(repositories, g.min_rating, *(tuple(sorted(set(v))) for v in (g.colors, g.likes, g.locks)), keys))
    return sorted(out, key=lambda g: json.dumps(asdict(g)))


def rule_matches(assets: DataFrame, groups: list[Group], tags: DataFrame | None = None) -> DataFrame:
    """Live assets that any group matches: one scan with one predicate.

    ``tags`` (asset_id, tag_key) are needed where a group names tags; an asset's tags among those named are one array.
    """
    groups = canonical_rule(groups)
    live = assets.where("deleted_at is null")
    named = sorted({k for g in groups for k in g.tag_keys})
    if named:
        held = tags.where(F.col("tag_key").isin(named)).groupBy(F.col("asset_id").alias("__a")).agg(F.collect_set("tag_key").alias("__tags"))
        live = live.join(held, F.col("id") == F.col("__a"), "left")
    hit = reduce(lambda a, b: a | b, (g.column() for g in groups), F.lit(False))
    return live.where(hit).select("repository_id", F.col("id").alias("asset_id"))


def reconcile_members(members: DataFrame, exclusions: DataFrame, assets: DataFrame, events: DataFrame, groups: list[Group], cursor) -> DataFrame:
    """Members after the change-log events beyond ``cursor``: those that now match join, unless excluded; none leaves.

    ``events`` are (event_at, asset_id); only assets they name are looked at. Repeated events and
    members count once.
    """
    touched = events.where(F.col("event_at") > F.lit(cursor)).select(F.col("asset_id").alias("id")).where("id is not null").distinct()
    joined = rule_matches(assets.join(touched, "id", "left_semi"), groups).join(exclusions, ["repository_id", "asset_id"], "left_anti")
    return members.select("repository_id", "asset_id").unionByName(joined).distinct()


def member_counts(members: DataFrame) -> DataFrame:
    """Members of each collection in total and by library, the latter as a JSON object."""
    per = members.groupBy("bucket", "repository_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("bucket").agg(F.sum("n").alias("n_members"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("repository_id", "n"))))).alias("by_repository"))


def rule_from_filter(f, repositories: list[str]) -> list[Group]:
    """A browsing filter as the groups of a rule: one where all conditions must hold, else one for each; raises on a dimension rules don't have."""
    unsupported = [n for n in ("cameras", "lenses", "taken", "iso", "focal", "flag_in", "flag_not_in", "text") if getattr(f, n)]
    if unsupported:
        raise ValueError("not expressible as a rule: " + ", ".join(unsupported))
    scope = tuple(r for r in repositories if r.strip())
    given = {"min_rating": f.min_rating, "colors": f.colors, "likes": f.likes, "locks": f.locks, "tag_keys": f.tag_keys}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None and v != []}
    parts = [given] if f.match == "all" else [{k: v} for k, v in given.items()] or [{}]
    return canonical_rule([Group(scope, **p) for p in parts])


def directory_tags(tagged: DataFrame) -> DataFrame:
    """(directory_key, tag_key), distinct, of acceptable directories: below ``photos/``, without empty, dot and backslash segments.

    A directory's tags are its own: its photos do not inherit them.
    """
    segments = F.split("directory_key", "/")
    ok = F.col("directory_key").startswith("photos/") & ~F.exists(segments, lambda s: s.isin("", ".", "..")) & ~F.contains("directory_key", F.lit("\\"))
    return tagged.where(ok & F.col("tag_key").isNotNull()).select("directory_key", "tag_key").distinct()


def directory_tag_counts(tagged: DataFrame) -> DataFrame:
    return directory_tags(tagged).groupBy("tag_key").agg(F.count(F.lit(1)).alias("n_directories"))


def effective_ids(effective: DataFrame, terms: DataFrame, legacy: DataFrame) -> DataFrame:
    """(asset_id, tag_id): effective tags by the number their term has, and old attachments whose number no term has taken over."""
    t = terms.where("tag_id is not null").select("tag_key", "tag_id")
    aligned = effective.join(t, "tag_key").select("asset_id", "tag_id")
    return aligned.unionByName(legacy.select("asset_id", "tag_id").join(t.select("tag_id").distinct(), "tag_id", "left_anti").select("asset_id", "tag_id")).distinct()


def commit_results(current: DataFrame, offered: DataFrame, attempts: DataFrame) -> DataFrame:
    """Results by asset after offers are taken in: (asset_id, source_key, payload, valid).

    An offer (asset_id, token, source_key, payload) counts only if the asset's open attempt has its token and its source; it
    replaces the asset's result whole. Of several such offers the least payload is taken.
    """
    a = attempts.select("asset_id", "token", "source_key").distinct()
    taken = offered.join(a, ["asset_id", "token", "source_key"], "left_semi").groupBy("asset_id").agg(F.min(F.struct("payload", "source_key")).alias("o"))
    taken = taken.select("asset_id", "o.source_key", "o.payload", F.lit(True).alias("valid"))
    return current.join(taken.select("asset_id"), "asset_id", "left_anti").select("asset_id", "source_key", "payload", "valid").unionByName(taken)


def invalidate_results(results: DataFrame, sources: DataFrame) -> DataFrame:
    """``results`` where one whose source has changed is no longer valid; ``sources`` are (asset_id, current_source)."""
    j = results.join(sources.groupBy("asset_id").agg(F.max("current_source").alias("__now")), "asset_id", "left")
    return j.withColumn("valid", F.col("valid") & F.coalesce(F.col("source_key") == F.col("__now"), F.lit(True))).drop("__now")


def prune_log(log: DataFrame, cursor: int, at_most: int = 1024) -> DataFrame:
    """The log without its first ``at_most`` events up to the committed cursor; a cursor of 0 or less prunes nothing."""
    if cursor <= 0:
        return log
    gone = log.where(F.col("event_id") <= cursor).select("event_id").orderBy("event_id").limit(at_most)
    return log.join(gone, "event_id", "left_anti")


def collection_order(collections: DataFrame) -> DataFrame:
    """Pinned ones first, then those with a rule, then by folded name and id."""
    return collections.orderBy(F.col("pinned").desc(), F.col("rule").isNotNull().desc(), "name_folded", "id")


def edit_members(members: DataFrame, exclusions: DataFrame, added: DataFrame, removed: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Members and exclusions after edits by hand: adding clears an exclusion, removing sets one; what is both added and removed ends removed."""
    members, exclusions, added, removed = (df.select(*key).distinct() for df in (members, exclusions, added, removed))
    now = members.unionByName(added).distinct().join(removed, key, "left_anti")
    out = exclusions.join(added, key, "left_anti").unionByName(removed).distinct()
    return now, out
